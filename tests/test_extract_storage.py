"""Answer spans and writers."""

import pytest
from pyspark.sql import functions as F

from vettiver.functions.extract import answer_span
from vettiver.functions.register import register_functions
from vettiver.operators import storage


@pytest.mark.parametrize(
    ("query", "unit", "language", "span", "method"),
    [
        ("குளிர்பதனம் எத்தனை செல்சியஸ் அளவில் இயங்கும்?", "அறை 18 டிகிரி செல்சியஸ் அளவில் இருக்கும்", "ta", "18 டிகிரி செல்சியஸ்", "numeric_unit"),
        ("टंकी में क्या लगा है?", "कुएँ से तेल पंप करने वाला यंत्र पुराना है", "hi", "यंत्र", "pump_relation"),
        ("द्वीप की मुख्य नगरी?", "उस द्वीप की राजधानी कमलपुर में है", "hi", "कमलपुर", "capital_relation"),
        ("which lake is deep?", "4. Tarn - the fourth", "en", "Tarn", "list_head"),
        ("which boat is oldest?", "The barge Ilse is the oldest boat", "en", "The barge Ilse", "leading_entity"),
        ("old bridge?", "old bridge", "en", None, None),
        ("old bridge?", "", "en", None, None),
    ],
)
def test_rules(spark, query, unit, language, span, method):
    row = spark.createDataFrame([(query, unit, language)], "q string, u string, l string").select(answer_span(F.col("q"), F.col("u"), F.col("l")).alias("a")).first()["a"]
    assert (row and (row["span"], row["method"])) == (span and (span, method))


def test_vectors_load_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0], "ta"), (2, [2.0], "hi")], "vector_row bigint, embedding array<float>, language string")
    path = str(tmp_path / "v")
    assert storage.load_vectors(rows, path)
    assert not storage.load_vectors(rows, path)
    changed = spark.createDataFrame([(1, [1.0], "ta"), (2, [2.5], "hi")], rows.schema)
    assert storage.load_vectors(changed, path) and not storage.load_vectors(changed, path)
    assert storage.missing_languages(rows, path, ["ta", "hi", "en"]) == ["en"]
    assert storage.load_vectors(rows.limit(1), path) and spark.read.parquet(path).count() == 1


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", [1, 2])], "x string, y array<int>")
    storage.write_csv(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in storage.read_csv(spark, str(tmp_path / "c"), "x string, y string").collect()] == [("a,b", "1|2")]
    storage.write_report(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["y"] == [1, 2]


def test_registered_function(spark):
    register_functions(spark)
    assert spark.sql("SELECT nfkc_fold('ＡＢß')").first()[0] == "abss"
    assert spark.sql("SELECT tokenize('Old Bridge, 1904')").first()[0] == ["old", "bridge", "1904"]
    assert spark.sql("SELECT collapse_blanks(' a\u00a0\n b ')").first()[0] == "a b"
    assert spark.sql("SELECT share_matched(tokenize('old bridges'), tokenize('a bridge'))").first()[0] == 0.5
    assert [tuple(r) for r in spark.sql("SELECT * FROM terms_of('Old bridge')").collect()] == [(0, "old"), (1, "bridge")]
