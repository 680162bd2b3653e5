"""The catalogue as CSV text."""

import glob

from shelfspark.plans import queries_more as M
from shelfspark.sources.catalog import catalog_view
from tests.conftest import SF_SMALL


def test_csv_text_is_written_compressed_in_bounded_files(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(M, "CSV_FILE_ROWS", 500, raising=False)
    monkeypatch.setattr(M, "read_catalog", lambda s, path, keep=M.read_catalog: paths.append(path) or keep(s, path))
    got = M.q_catalog_from_csv(spark, SF_SMALL)
    want = catalog_view(spark, SF_SMALL)
    files = glob.glob(f"{paths[0].removeprefix('file:')}/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files) and len(files) >= want.count() // 500
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)
