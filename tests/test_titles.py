from pyspark.sql import functions as F

from ostinato.functions import titles as tt


def values(spark, rows, fn):
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_catalog_numbers(spark):
    got = values(spark, ["Mass, BWV 232", "Sonata S. 1001", "Die Zauberflöte, KV 620", "Étude op. 10 no. 3", "Haydn Hob. III:77", "Symphony No. 5", "Opus 9a",
                         "Winterreise, D. 911", "Slavonic B. 78", "plain", "", None], tt.catalog_number)
    assert got == ["BWV 232", "BWV 1001", "K. 620", "Op. 10 no. 3", "Hob. III:77", "No. 5", "Op. 9a", "D. 911", "B. 78", None, None, None]


def test_all_catalog_numbers(spark):
    got = values(spark, ["Op. 8 No. 1, RV 269", "nothing", None], tt.all_catalog_numbers)
    assert got == [["Op. 8 No. 1", "RV 269", "No. 1"], [], []]


def test_work_types(spark):
    rows = {
        "Le quattro stagioni, Op. 8": "Concerto", "Die Jahreszeiten": "Oratorio", "Die Zauberflöte, KV 620": "Opera", "Ópera en 3 actos": "Opera",
        "ÉTUDES op. 10": "Etude", "La Mer / Images": "Suite", "La Mer": "Tone Poem", "Images / Preludes": "Prelude", "Symphonie fantastique": "Symphony",
        "Concert pour violon": None, "Concerts royaux": "Concerto", "String Quartet in G": "String Quartet", "Quartett": "Quartet", "Lieder": "Song",
        "Operation": None, "": None,
    }
    assert values(spark, list(rows), tt.work_type) == list(rows.values())
    assert values(spark, ["Sonata and Fugue, quattro stagioni", None], tt.all_work_types) == [["Sonata", "Fugue"], []]


def test_keys(spark):
    rows = {
        "Symphony in D minor": "D minor", "Sonata No. 3 c-moll": "C minor", "Messe A-Dur": "A major", "Suite in E♭ major, BWV 1010": "E♭ major",
        "Nocturne in C-sharp minor": "C♯ minor", "Waltz in Bb major": "B♭ major", "Lieder am Klavier": "A major", "Prelude in Cm": "C major",
        "Sonata in C": "C major", "Sonata in f, Op. 2": "F minor", "In the style": None, "": None,
    }
    assert values(spark, list(rows), tt.musical_key) == list(rows.values())
    assert values(spark, ["Lieder am Klavier", "Suite in E major"], lambda c: tt.musical_key(c, strict=True)) == [None, "E major"]


def test_periods(spark):
    rows = [("1685", "1750"), ("1809-02-03", None), ("0", None), ("-500", None), (None, "1900"), ("1756-01-27", "1791"), ("abc", None), ("1330", "1390"), ("1985", None)]
    df = spark.createDataFrame(rows, "b string, d string")
    df = df.select(tt.year_of(F.col("b")).alias("b"), tt.year_of(F.col("d")).alias("d"))
    got = [r[0] for r in df.select(tt.period_of("b", "d")).collect()]
    assert got == ["Baroque", "Romantic", None, None, None, "Classical", None, "Medieval", "Contemporary"]
