import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import quality
from loomtext.operators.clean import chunk_text, clean_records


def one(spark, make, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", make(F.col("t")).alias("r")).orderBy("k").collect()
    return [r.r for r in rows]


def test_whitespace_and_lines(spark):
    assert one(spark, T.normalize_whitespace, "a\r\nb   \n\n\n\nc ", "", None) == ["a\nb\n\nc", "", None]
    assert one(spark, T.join_record_lines, " a \n\n b", None) == ["a\nb", None]


def test_markers_round_trip(spark):
    texts = ["plain", f"{T.ESC}{T.MARKER}", f"{T.ESC}{T.ESC}{T.MARKER}{T.MARKER}{T.ESC_MARK}", f"{T.ESC}{T.ESC_MARK}", ""]
    assert one(spark, lambda c: T.unescape_markers(T.escape_markers(c)), *texts) == texts


def test_boilerplate(spark):
    assert one(spark, T.is_boilerplate, "Share this: a page", "  ", "A line of text that stays.", "Produced by someone", "Producedby", "related articles") == [True, True, False, True, False, False]
    assert one(spark, T.drop_boilerplate, "one\nTable of Contents\n\ntwo") == ["one\ntwo"]


def test_html(spark):
    assert one(spark, T.strip_html, "<p>a &amp;lt; b</p><script>x</script>") == [" a &lt; b  "]


def test_ngram_spam_and_loops(spark):
    spam = "buy the best one " * 12
    assert one(spark, T.ngram_spam, spam, "short text", "") == [True, False, False]
    assert one(spark, T.has_loop, "a b c a b c a b c", "a b c d", None) == [True, False, False]
    assert one(spark, lambda c: T.max_count(F.split(c, " ")), "a b a c a") == [3]


def test_assess(spark):
    good = "The river was high after the rain and the people of the town came to see it from the old bridge."
    cases = {
        good: "keep", "too short": "too_short", "a " * 20: "mean_word_length_low", "abcdefghijklmnop " * 20: "mean_word_length_high", "#$% ab&*( " * 20: "symbol_soup",
        "1234 abcde " * 20: "mostly_digits", "the same line of words again\n" * 6: "repeated_lines", "это просто русский текст и он не на латинице вовсе а значит его не берут " * 2: "not_latin_script",
        "les arbres verts grandissent toujours près des rivières froides pendant chaque printemps humide sous montagnes grises": "not_english_prose",
    }
    assert one(spark, quality.assess, *cases) == list(cases.values())
    assert one(spark, quality.assess, None) == ["too_short"]


def test_structural_rules(spark):
    def flags(text, source="web_x"):
        rules = quality.structural_rules(F.lit(text), F.lit(source))
        row = spark.range(1).select(*[c.alias(n) for n, c in rules.items()]).first()
        return [n for n, v in row.asDict().items() if v]

    assert flags("word " * 100 + "end") == ["no_sentence_punct"] or "no_sentence_punct" in flags("word " * 100 + "end")
    assert "no_sentence_punct" not in flags("word " * 98)
    assert "link_farm" in flags("http://a.example/x word " * 8) and "link_farm" not in flags("http://a.example/x word " * 7)
    assert "all_caps" in flags("WORD " * 40) and "all_caps" not in flags("WORD " * 39)
    assert "replacement_chars" in flags("a���") and "replacement_chars" not in flags("a��")
    assert "spam_punctuation" in flags("wow!!!!!") and "spam_punctuation" not in flags("wow!!!!")
    assert flags("WORD " * 40, "code_x") == []
    assert flags("", "web_x") == [] and flags(None, None) == []


def test_bits(spark):
    df = spark.range(1).select(quality.bitmask(["a", "b", "c"], {"a": F.lit(True), "c": F.lit(True), "b": F.lit(None).cast("boolean")}).alias("bits"))
    row = df.withColumn("names", quality.decode_bits(["a", "b", "c"], F.col("bits"))).first()
    assert (row.bits, row.names) == (5, ["a", "c"])


def test_chunks():
    assert chunk_text("x" * 19) == [] and chunk_text("x" * 20) == ["x" * 20]
    text = ("A sentence of some words here. " * 200).strip()
    chunks = chunk_text(text)
    assert all(20 <= len(c) <= 3000 for c in chunks) and " ".join(chunks) == text.strip()
    assert [len(c) for c in chunk_text("y" * 6010)] == [3000, 3000]  # the last ten characters are too few
    a, b = "p" * 1600, "q" * 1600
    assert chunk_text(f"{a}\n\n{b}") == [a, b]


def test_clean_records(spark):
    df = spark.createDataFrame([(1, "<p>Caf&eacute; culture is old, they say.</p>", 0), (2, None, 0), (3, "  ", 0), (4, "Privacy Policy and more\n\nSomething of length enough.", 0)], "id int, text string, chunk_no int")
    got = {(r.id, r.chunk_no): r.text for r in clean_records(df, "id", "text", strip_markup=True).collect()}
    assert got == {(1, 0): "Café culture is old, they say.", (4, 0): "Something of length enough."}
    assert clean_records(df.limit(0), "id", "text").count() == 0


CLEAN_CASES = [
    ("blank lines go", "First paragraph of the text.\n\n\n\nSecond paragraph of the text.", False, ["First paragraph of the text.\nSecond paragraph of the text."]),
    ("entities are decoded once", "<p>He wrote &amp;lt;b&amp;gt; in the box</p> and &eacute;t&eacute;", True, ["He wrote &lt;b&gt; in the box  and été"]),
    ("an image without a description keeps its target", "See ![enter image description here](http://a.example/i.png) for the plan.", False, ["See ![](http://a.example/i.png) for the plan."]),
    ("furniture", "Share this:\nPossible Duplicate: some other one\nedit 2:\nThis is the text that stays here.\nProduced by many hands", False, ["This is the text that stays here."]),
    ("sharing lines are matched with case", "share this: it is what the text says", False, ["share this: it is what the text says"]),
    ("too short", "nineteen characters", False, []),
    ("a long sentence is cut, its short rest dropped", "x" * 3010, False, ["x" * 3000]),
    ("sentences are packed", "a" * 1990 + ". " + "b" * 1500 + ".", False, ["a" * 1990 + ".", "b" * 1500 + "."]),
    ("carriage returns and blanks before them", "one line of text    \r\nanother line of text", False, ["one line of text\nanother line of text"]),
]


@pytest.mark.parametrize("name,raw,markup,want", CLEAN_CASES, ids=[c[0] for c in CLEAN_CASES])
def test_clean_cases(spark, name, raw, markup, want):
    got = clean_records(spark.createDataFrame([(1, raw)], "id int, text string"), "id", "text", strip_markup=markup).orderBy("chunk_no").collect()
    assert [r.text for r in got] == want


def test_repair_comes_first(spark):
    """A repair works on the text as it was delivered, before tags go, whether markup is stripped or not."""
    df = spark.createDataFrame([(1, "<p>The caf~ of the town is closed</p>")], "id int, text string")
    fix = lambda t: t.replace("caf~", "café") if t.startswith("<p>") else "too late, this text was changed"
    assert clean_records(df, "id", "text", True, repair=fix).first().text == "The café of the town is closed"
    assert clean_records(df, "id", "text", False, repair=fix).first().text == "<p>The café of the town is closed</p>"


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200)
    a = df.repartition(1).select("id", T.draw(F.lit("s"), F.col("id")).alias("d"))
    b = df.repartition(7).select("id", T.draw(F.lit("s"), F.col("id")).alias("d"))
    assert a.exceptAll(b).isEmpty()
