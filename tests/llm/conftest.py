import pytest

from folio_spark.llm import base


@pytest.fixture(autouse=True, scope="session")
def _checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    base.ensure_checkpoint_dir(spark)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty texts, ties, repeated rows, an extra column of a clashing name."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "x"),
        (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "x"),
        (2, "alpha BETA gamma delta epsilon zeta eta theta", "en", "x"),
        (3, "", "en", None),
        (4, None, None, None),
        (5, " \n\t ", "de", "y"),
        (6, "one two", "en", "y"),
        (7, "ONE two", "fr", "y"),
        (8, "Ünï çödé — wörds here", "de", "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string")
