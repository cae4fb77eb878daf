import os

import pytest

from lodestone.sources.corpus import find_root, list_files
from lodestone.sources.ignore import IgnoreRules, excluded

FILES = {".gitignore": "*.log\n/build/\n!keep.log\n# c\ndocs/**/draft.md\nnode_modules/\n\\#odd\nt?st.x\n[ab].y\n", ".ignore": "!special.log\n", "sub/.gitignore": "!deep.log\nlocal.txt\n", "sub/.ignore": "x.only\n"}


@pytest.mark.parametrize(
    "path,ignored",
    [("a.log", True), ("keep.log", False), ("special.log", False), ("build/x", True), ("sub/build/x", False), ("docs/a/b/draft.md", True), ("docs/draft.md", True), ("node_modules/a/b.js", True), ("sub/node_modules/z", True),
     ("#odd", True), ("test.x", True), ("a.y", True), ("c.y", False), ("sub/deep.log", False), ("sub/local.txt", True), ("local.txt", False), ("sub/x.only", True), ("sub/other.log", True), (".hidden", False)],
)
def test_rules(path, ignored):
    assert IgnoreRules.of(FILES).ignored(path) == ignored


def test_hard_exclusions():
    assert all(excluded(p) for p in ["a/.git/x", ".lodestone/x", "scratch.py", "a/b.tmp", "x~", "y.swp", "z.bak"]) and not excluded("a/git/x.py")


def test_listing_agrees_with_the_matcher(tmp_path):
    names = ["a.log", "keep.log", "special.log", "build/x", "sub/build/x", "docs/a/draft.md", "node_modules/m.js", "sub/deep.log", "sub/local.txt", "local.txt", ".hidden", "_under", "sub/y/z.py", "ä.txt", "x.tmp"]
    for n in [*names, *FILES]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(FILES.get(n, "x"))
    os.symlink(tmp_path / "local.txt", tmp_path / "link.txt")
    rules = IgnoreRules.of(FILES)
    found = [p for p, _ in list_files(str(tmp_path)).files]
    assert found == sorted(n for n in [*names, *FILES] if not rules.ignored(n))


def test_find_root(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    with pytest.raises(LookupError):
        find_root(str(tmp_path / "a/b"))
    (tmp_path / ".lodestone").mkdir()
    assert find_root(str(tmp_path / "a/b")) == os.path.realpath(tmp_path)
    (tmp_path / "a/.lodestone").symlink_to(tmp_path / ".lodestone")
    with pytest.raises(PermissionError):
        find_root(str(tmp_path / "a/b"))
