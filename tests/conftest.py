import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_pages(spark):
    def build(*htmls, urls=None, status=None):
        rows = [
            (i, (urls or {}).get(i, f"https://example.org/{i}"), (status or {}).get(i, 200), html)
            for i, html in enumerate(htmls)
        ]
        return spark.createDataFrame(rows, "page_id long, url string, status int, html string")
    return build


@pytest.fixture(scope="session")
def model(spark):
    from glossaudit.operators import langid

    samples = {
        "en": ["the quick brown fox jumps over the lazy dog and runs away from the house with the children",
               "this is a long paragraph of english text that should be easy to recognise for everyone"],
        "de": ["der schnelle braune fuchs springt über den faulen hund und läuft weg von dem haus mit den kindern",
               "dies ist ein langer absatz mit deutschem text der für alle leicht zu erkennen sein sollte"],
        "fr": ["le renard brun rapide saute par dessus le chien paresseux et s'enfuit de la maison avec les enfants",
               "ceci est un long paragraphe de texte français qui devrait être facile à reconnaître pour tous"],
    }
    rows = [(lang, text) for lang, texts in samples.items() for text in texts]
    return langid.train(spark.createDataFrame(rows, "lang string, text string"))
