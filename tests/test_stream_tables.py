"""The tables that the stream of tables reads."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq

from matewise.plans import file_queries

SF = "/root/testdata/sf0.001"


def test_tables_of_a_stream_can_be_shared_out(spark, tmp_path, monkeypatch):
    """Each file has several row groups, so a batch of few files is many tasks."""
    monkeypatch.setattr(file_queries, "GROUP", 1 << 15, raising=False)
    monkeypatch.setattr(file_queries, "folder", lambda s, label: str(tmp_path))
    assert file_queries.stream_assemble(spark, SF).count() > 1000
    files = glob.glob(f"{tmp_path}/in/*.parquet")
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > len(files)
