"""Published versions: commits, failed and concurrent builds, changed inputs, expiry."""

from __future__ import annotations

import os

import pytest

from ledgerlens.operators.ingest import RAW_HEADERS
from ledgerlens.plans import job, versions
from ledgerlens.plans.datasets import ensure_dataset
from ledgerlens.plans.report import refresh_page

ROW = dict(zip(RAW_HEADERS, ["536365", "85123A", "HOLDER", "6", "2010-12-01 08:26:00", "2.55", "17850", "France"]))


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [",".join(RAW_HEADERS), *(",".join(r[h] for h in RAW_HEADERS) for r in rows)]
    (folder / name).write_text("\n".join(lines) + "\n")
    return {"P": str(folder)}


def test_a_version_holds_all_outputs_of_one_build(spark, tmp_path):
    sources = _write(tmp_path / "in", "a.csv", [ROW, ROW | {"Quantity": "x"}])
    root = str(tmp_path / "retail")
    first = job.publish_dataset(spark, sources, root)
    assert first.number == 1 and first.notes["staged_rows"] == 1 and first.notes["output_parquet"] == "retail"
    paths = job.published_paths(spark, root)
    assert spark.read.parquet(paths["curated"]).count() == job.read_lines(spark, root).count() == 1
    assert spark.read.csv(paths["quarantine"], header=True).count() == 1
    assert spark.read.json(paths["report"]).first().quarantined_rows == 1
    # unchanged inputs: the version is given again, without a build
    assert job.publish_dataset(spark, sources, root) == first
    assert job.publish_dataset(spark, sources, root, force=True).number == 2
    # a new file: a new version; a reader of the old one still has its files
    old = spark.read.parquet(job.published_paths(spark, root)["curated"])
    _write(tmp_path / "in", "b.csv", [ROW, ROW])
    assert job.publish_dataset(spark, sources, root).number == 3
    assert job.read_lines(spark, root).count() == 3 and old.count() == 1


@pytest.mark.parametrize("step", ["write_curated", "quality_summary", "curate"])
def test_a_failed_build_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    sources = _write(tmp_path / "in", "a.csv", [ROW])
    root, plain = str(tmp_path / "retail"), str(tmp_path / "plain.parquet")
    before = job.publish_dataset(spark, sources, root)
    job.build_dataset(spark, sources, plain)
    _write(tmp_path / "in", "b.csv", [ROW | {"Quantity": "x"}, ROW])

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(job, step, killed)
    with pytest.raises(KeyboardInterrupt):
        job.publish_dataset(spark, sources, root)
    with pytest.raises(KeyboardInterrupt):
        job.build_dataset(spark, sources, plain)
    assert versions.current(spark, root) == before and job.read_lines(spark, root).count() == 1
    assert os.listdir(f"{root}/versions") == [os.path.basename(before.folder)]
    assert spark.read.parquet(plain).count() == 1
    assert sorted(n for n in os.listdir(tmp_path) if "plain" in n) == ["plain.parquet", "plain.quality.json"]
    monkeypatch.undo()
    assert job.publish_dataset(spark, sources, root).number == 2
    assert job.build_dataset(spark, sources, plain).first().quarantined_rows == 1


def test_a_build_killed_before_its_rename_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    write = lambda n: lambda folder: spark.range(n).write.parquet(folder)
    versions.publish(spark, root, write(3))
    real = versions.file_system

    class NoRename:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                return lambda *_: False
            return getattr(self.fs, name)

    monkeypatch.setattr(versions, "file_system", lambda s, p: (NoRename(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError):
        versions.publish(spark, root, write(5))
    monkeypatch.undo()
    assert spark.read.parquet(versions.current(spark, root).folder).count() == 3
    # its number stays claimed: the next build takes another one
    assert versions.publish(spark, root, write(7)).number == 3


def test_two_builds_at_a_time_get_two_numbers(spark, tmp_path):
    root, inner = str(tmp_path / "table"), []

    def outer(folder):
        spark.range(1).write.parquet(folder)
        inner.append(versions.publish(spark, root, lambda f: spark.range(2).write.parquet(f)))

    last = versions.publish(spark, root, outer)
    assert [inner[0].number, last.number] == [1, 2] == versions.history(spark, root)
    assert spark.read.parquet(versions.current(spark, root).folder).count() == 1


def test_expire_keeps_the_last_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    for n in range(1, 5):
        versions.publish(spark, root, lambda folder: spark.range(n).write.parquet(folder), notes_digest(n))
    assert versions.expire(spark, root, keep=2) == [1, 2]
    assert versions.history(spark, root) == [3, 4] and len(os.listdir(f"{root}/versions")) == 2
    assert spark.read.parquet(versions.committed(spark, root, 3).folder).count() == 3
    with pytest.raises(ValueError):
        versions.expire(spark, root, keep=0)


def notes_digest(n):
    return f"digest-{n}"


def test_digest_follows_files_not_their_order(spark, tmp_path):
    folder = tmp_path / "in"
    _write(folder, "a.csv", [ROW])
    one = versions.input_digest(spark, [str(folder)])
    assert versions.input_digest(spark, [str(folder)]) == one
    _write(folder, "b.csv", [])
    two = versions.input_digest(spark, [str(folder)])
    os.utime(folder / "b.csv", (1, 1))
    three = versions.input_digest(spark, [str(folder)])
    (folder / "b.csv").unlink()
    assert len({one, two, three}) == 3 and versions.input_digest(spark, [str(folder)]) == one
    assert versions.input_digest(spark, [str(tmp_path / "none")]).endswith(":none")


def test_ensure_dataset_builds_again_when_an_input_changes(spark, tmp_path):
    folder, path, calls = tmp_path / "in", str(tmp_path / "table"), []
    sources = _write(folder, "a.csv", [ROW])

    def builder():
        calls.append(1)
        return spark.read.csv(sources["P"], header=True)

    assert [ensure_dataset(spark, path, builder, inputs=[sources["P"]]).count() for _ in range(3)] == [1, 1, 1]
    _write(folder, "b.csv", [ROW, ROW])
    assert [ensure_dataset(spark, path, builder, inputs=[sources["P"]]).count() for _ in range(2)] == [3, 3]
    assert len(calls) == 2


def test_the_page_reads_the_current_version(spark, tmp_path):
    sources = _write(tmp_path / "in", "a.csv", [ROW, ROW | {"Invoice": "536366"}])
    root = str(tmp_path / "retail")
    job.publish_dataset(spark, sources, root)
    kpis = refresh_page(spark, root, str(tmp_path / "page"))
    assert kpis["orders"] == 2 and kpis["revenue"] == 30.6


def test_nothing_published(spark, tmp_path):
    assert versions.current(spark, str(tmp_path)) is None
    with pytest.raises(FileNotFoundError):
        job.published_paths(spark, str(tmp_path))


def test_the_job_publishes_versions(spark, tmp_path, capsys):
    sources = _write(tmp_path / "in", "a.csv", [ROW])
    args = ["--input", f"P={sources['P']}", "--output", str(tmp_path / "retail"), "--versioned"]
    job.main(args)
    assert '"staged_rows": 1' in capsys.readouterr().out
    assert job.read_lines(spark, str(tmp_path / "retail")).count() == 1
