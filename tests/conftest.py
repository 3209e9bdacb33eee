import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        # Not UTC on purpose: no result may depend on the session time zone.
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lexicon(spark):
    from newsloom.plans import fixtures

    return fixtures.lexicon(spark)


@pytest.fixture()
def make_articles(spark):
    """Articles from dicts; fields not given are empty."""
    import datetime as dt

    from newsloom.schema import ARTICLE_SCHEMA

    blank = {
        "category": "", "headline": "", "authors": "", "link": "", "short_description": "",
        "date": "2018-01-01", "date_ts": dt.datetime(2018, 1, 1),
        "sentiment_score": 0.0, "sentiment_polarity": "Positive",
    }

    def make(*rows):
        filled = [{"doc_id": i, **blank, **row} for i, row in enumerate(rows)]
        names = ARTICLE_SCHEMA.fieldNames()
        return spark.createDataFrame([tuple(r[n] for n in names) for r in filled], ARTICLE_SCHEMA)

    return make
