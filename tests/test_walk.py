"""Directory trees walked by executors."""

import os

import pytest

from planes.operators import recall
from planes.sources.files import from_manifest
from planes.sources.walk import list_tree
from tests.test_usage import write

UUID = "01234567-89ab-cdef-0123-456789abcde"


def listed(spark, roots, **how):
    rows = list_tree(spark, roots, "s", **how).collect()
    assert all(r.source_id == "s" and not r.is_symlink for r in rows)
    return rows


def tree(tmp_path):
    root = f"{tmp_path}/h/.claude/projects"
    for name in (f"p/{UUID}f.jsonl", "_under/_x.jsonl", ".dot/.hidden.jsonl", "p/deep/er/still/a.json", "empty.txt", "p/sp ace 'é.jsonl"):
        write(f"{root}/{name}", name if name != "empty.txt" else "")
    return root


@pytest.mark.parametrize("entries", [1, 3, 1000])
def test_every_regular_file_is_listed_once_however_the_walk_is_cut(spark, tmp_path, entries):
    root = tree(tmp_path)
    for i in range(40):
        write(f"{root}/wide/{i}/f.jsonl", "x" * i)
    rows = listed(spark, [root], entries=entries, folder=f"{tmp_path}/w")
    want = {os.path.join(d, f) for d, _, names in os.walk(root) for f in names}
    assert len(rows) == len(want) and {r.path for r in rows} == want
    for r in rows:
        assert (r.root, r.root_no, r.size, r.mtime_ms) == (root, 0, os.path.getsize(r.path), os.stat(r.path).st_mtime_ns // 1_000_000)


def test_links_do_not_lead_out_of_the_root(spark, tmp_path):
    root = tree(tmp_path)
    outside = write(f"{tmp_path}/outside/{UUID}e.jsonl", '{"leak":1}')
    os.symlink(f"{tmp_path}/outside", f"{root}/escape")
    os.symlink(outside, f"{root}/p/{UUID}d.jsonl")
    os.symlink(f"{root}/p", f"{root}/inside")  # a link inside is not followed either
    os.symlink(root, f"{root}/p/loop")
    os.symlink("/nowhere", f"{root}/broken")
    os.mkfifo(f"{root}/pipe.jsonl")
    rows = listed(spark, [root])
    assert len(rows) == 6 and not any("outside" in r.path or "escape" in r.path or "loop" in r.path for r in rows)
    # The whole way to candidates, as for a listing made elsewhere.
    found = recall.candidates(from_manifest(list_tree(spark, [root], "s"))).collect()
    assert sorted(os.path.basename(r.path) for r in found) == sorted([f"{UUID}f.jsonl", "_x.jsonl", "a.json", "sp ace 'é.jsonl"])


def test_roots_may_be_links_missing_or_nested(spark, tmp_path):
    root = tree(tmp_path)
    os.symlink(root, f"{tmp_path}/link")
    plain = write(f"{tmp_path}/file.jsonl", "x")
    rows = listed(spark, [f"{tmp_path}/link", f"{tmp_path}/none", plain, f"{root}/p"])
    assert {r.root_no for r in rows} == {0, 3} and {r.root for r in rows if r.root_no == 0} == {root}
    nested = [r.path for r in rows if r.root_no == 3]
    assert len(nested) == 3 and set(nested) < {r.path for r in rows if r.root_no == 0}
    assert listed(spark, []) == []


def test_a_directory_that_became_a_link_is_not_entered(tmp_path):
    from planes.sources.walk import _entries

    os.makedirs(f"{tmp_path}/a/b")
    write(f"{tmp_path}/out/x.jsonl", "x")
    assert [e[0] for e in _entries(f"{tmp_path}/a")] == [f"{tmp_path}/a/b"]
    os.rmdir(f"{tmp_path}/a/b")
    os.symlink(f"{tmp_path}/out", f"{tmp_path}/a/b")
    assert list(_entries(f"{tmp_path}/a/b")) == []
