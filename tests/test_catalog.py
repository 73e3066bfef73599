import glob
import os
import shutil

import pyarrow.parquet as pq
import pytest

from framewright.plans import catalog, pictures
from tests.oracle import rows, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def few_vectors(tmp_path_factory):
    """The tables with a dozen vectors of each of three labels: pictures are compared on whole tables by the driver."""
    folder = tmp_path_factory.mktemp("few")
    for path in glob.glob(f"{SF}/*.parquet"):
        shutil.copy(path, folder)
    path = os.path.join(folder, "embeddings.parquet")
    whole = pq.read_table(path)
    os.chmod(path, 0o644)
    seen, kept = {0: 0, 1: 0, 2: 0}, []
    for label in whole.column("label").to_pylist():
        kept.append(seen.get(label, 12) < 12)
        seen[label] = seen.get(label, 12) + 1
    pq.write_table(whole.filter(kept), path)
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, few_vectors, name):
    folder = few_vectors if name in pictures.QUERIES else SF
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), views(folder).execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
