import hashlib
import os

from tessella.sources import readers as S


def scan(spark, root):
    rows, stats = S.scan_files(spark, [f"file://{root}"], includes=["*"])
    return {r.relative_path: r for r in rows.collect()}, {r.outcome: (r.n, r.bytes) for r in stats.collect()}


def disturb(monkeypatch, act):
    """act(n) runs after the n-th read, before the listing that checks it."""
    keep, reads = S.durable, []

    def durable(df, name):
        out = keep(df, name)
        if name == "read":
            reads.append(1)
            act(len(reads))
        return out

    monkeypatch.setattr(S, "durable", durable)
    return reads


def test_files_that_stay_are_read_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("alpha")
    (tmp_path / "b.bin").write_text("x")
    reads = disturb(monkeypatch, lambda n: None)
    rows, stats = scan(spark, tmp_path)
    assert list(rows) == ["a.md"] and stats == {"cataloged": (1, 5), "suffix": (1, 1)} and len(reads) == 1


def test_a_file_that_changed_once_is_read_again(spark, tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / f"{name}.md").write_text(name)

    def act(n):
        if n == 1:
            (tmp_path / "b.md").write_text("rewritten")

    reads = disturb(monkeypatch, act)
    rows, stats = scan(spark, tmp_path)
    assert stats == {"cataloged": (3, 11)} and len(reads) == 2
    assert rows["b.md"].content_sha256 == hashlib.sha256(b"rewritten").hexdigest() and rows["b.md"].head == "rewritten"


def test_a_file_that_always_changes_or_goes_is_not_cataloged(spark, tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / f"{name}.md").write_text(name)

    def act(n):
        (tmp_path / "b.md").write_text("x" * (n + 1))
        if n == 1:
            os.remove(tmp_path / "c.md")

    reads = disturb(monkeypatch, act)
    rows, stats = scan(spark, tmp_path)
    assert list(rows) == ["a.md"] and len(reads) == S.ATTEMPTS
    assert stats["cataloged"] == (1, 1) and stats["changed"][0] == 2
