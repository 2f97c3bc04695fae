import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomtext.sources import formats, records, sinks
from loomtext.streaming import corpus as stream


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_discovery_and_labels(spark, tmp_path):
    write(tmp_path / "web/a.JSONL", ['{"text": "x"}'])
    write(tmp_path / "low_quality/b.jsonl", ["{}"])
    write(tmp_path / "c_12.5mb.txt", ["x"])
    write(tmp_path / "d.bin", ["x"])
    found = records.discover(spark, str(tmp_path), exclude="low_quality")
    labelled = found.select(records.file_label(F.col("path")).alias("f"), records.directory_label(F.col("path"), tmp_path.name).alias("d")).collect()
    assert {(r.f, r.d) for r in labelled} == {("a.JSONL", "web"), ("c", "c_12.5mb")}
    with pytest.raises(FileNotFoundError):
        records.discover(spark, str(tmp_path), (".xml",))


def test_scan(spark, tmp_path):
    raw = ['{"text": "ok"}', '{"text": 5}', '{"text": "  "}', "[1]", "{bad", '{"other": 1}', "", '{"text": null}']
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, v string").select("k", records.scan_json(F.col("v")).alias("r")).orderBy("k")
    assert [r.r.status for r in df.collect()] == ["ok", "missing_text", "missing_text", "bad_json", "bad_json", "missing_text", "bad_json", "missing_text"]
    write(tmp_path / "x/a.jsonl", raw)
    assert [r.text for r in records.read_jsonl(spark, str(tmp_path / "x")).collect()] == ["ok"]
    with pytest.raises(ValueError, match="a.jsonl"):
        records.read_strict(spark, str(tmp_path / "x"), "text string")
    write(tmp_path / "y/a.jsonl", ['{"text": "a"}', "", '{"text": "b"}'])
    assert records.read_strict(spark, str(tmp_path / "y"), "text string").count() == 2


def test_eligible_lines(spark):
    df = spark.createDataFrame([(1, "a\r\n\n" + "é" * 6), (2, None), (3, "")], "id int, text string")
    got = [(r.id, r.line, r.state) for r in records.eligible_lines(df, ["id"], limit=10).orderBy("id", "line_no").collect()]
    assert got == [(1, "a", "eligible"), (1, "", "empty"), (1, "é" * 6, "oversized"), (3, "", "empty")]


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(k, "x" * 9) for k in range(20)], "pos long, text string")
    out = sinks.write_shards(df, "pos", "text", str(tmp_path / "s"), 200, 50).orderBy("shard").collect()
    # a line has 21 bytes, its end included: ten lines begin below 200
    assert sum(r.lines for r in out) == 10 and [r.lines for r in out] == [3, 2, 3, 2]
    lines = spark.read.text(str(tmp_path / "s")).count()
    assert lines == 10
    digests = sinks.shard_digests(spark, str(tmp_path / "s")).collect()
    assert {r.shard for r in digests} == {0, 1, 2, 3} and sum(r.bytes for r in digests) == 210
    for r in digests:
        assert r.sha256 == hashlib.sha256(next((tmp_path / "s" / f"shard={r.shard}").glob(r.file)).read_bytes()).hexdigest()


def test_manifest_and_frozen_set(spark, tmp_path):
    for content in ({"a": 1}, {"b": "é"}):
        sinks.write_manifest(spark, str(tmp_path / "m.json"), content)
        assert json.loads((tmp_path / "m.json").read_text()) == content
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["m.json"]
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, t string")
    p = str(tmp_path / "f.jsonl")
    sinks.save_frozen(df, "k", p)
    assert [r.t for r in sinks.load_frozen(spark, p, "k int, t string").orderBy("k").collect()] == ["a", "b"]
    text = (tmp_path / "f.jsonl").read_text().replace('"b"', '"c"')
    (tmp_path / "f.jsonl").write_text(text)
    with pytest.raises(ValueError, match="sha256"):
        sinks.load_frozen(spark, p, "k int, t string")


def test_ordered_corpus(spark, tmp_path):
    df = spark.range(500).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("t")).repartition(7)
    sinks.write_ordered(df, ["id"], "t", str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert text.splitlines() == [f"line {k}" for k in range(500)]


def test_formats(spark, tmp_path):
    page = "# tool\n> Packs files.\n> More at <a>.\n- Pack a folder:\n`tool -c x`\n- Unpack:\n`tool -x y`\n`tool --alone`\n"
    assert formats.command_page("my-tool", page) == "my tool: Packs files. More at <a>.\n\nPack a folder\ntool -c x\n\nUnpack\ntool -x y"
    assert formats.command_page("t", "> only words") == "" and formats.command_page("t", "- x:\n`y`") == "t\n\nx\ny"
    sheet = "# list\nls -l\nls -a\n\n# no command\n\nwho\n# size\ndu -h"
    assert formats.cheat_sheet("my_sheet", sheet) == "my sheet: list no command size\n\nls -l\nls -a\n\nwho\n\ndu -h" and formats.cheat_sheet("t", "# a") == ""
    assert formats.html_to_markdown("<p>a <b>b</b></p><ul><li>c</li></ul><pre><code>x &lt; y</code></pre>") == "a **b**\n\n- c\n\n```\nx < y\n```"
    assert formats.html_to_markdown('<blockquote><p>said</p><p>twice</p></blockquote><p><img src="i.png" alt="a plan"> <a href="u">l</a> <a name="n">m</a></p>') == "> said\n>\n> twice\n\n![a plan](i.png) [l](u) m"
    assert formats.html_to_markdown("<ol><li>x</li><li>y<ul><li>z</li></ul></li></ol>&lt;target&gt;") == "1. x\n2. y\n  - z\n\n<target>"
    rows = ['Id="1" Body="&lt;p&gt;Hi Joe&lt;/p&gt;" OwnerDisplayName="Joe"', 'Id="2" Text="a &amp;amp; b"', 'Id="3" Text="Ann met Joe" DisplayName="Ann"', 'Id="4" Text="Joe again" DisplayName="Joe"', 'Id="5" Text=" " DisplayName="Joe"']
    (tmp_path / "p.xml").write_text("<posts>" + "".join(f"<row {r}/>" for r in rows) + "</posts>")
    plain = {r.id: r.text for r in formats.read_posts(spark, str(tmp_path / "p.xml")).collect()}
    assert plain == {1: "Hi Joe", 2: "a & b", 3: "Ann met Joe", 4: "Joe again"}
    masked = {r.id: r.text for r in formats.read_posts(spark, str(tmp_path / "p.xml"), mask=True).collect()}
    joe, ann = masked[1].removeprefix("Hi "), masked[3].removesuffix(" met Joe")
    assert masked[4] == f"{joe} again" and joe != ann and "Joe" not in joe and "Ann" not in ann and masked[2] == "a & b"


def test_streams(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"in/{k}.jsonl", [json.dumps({"text": f"{k} {n}"}) for n in range(4)] + ["bad"])
    q = stream.read_corpus(spark, str(tmp_path / "in"), 1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    # a restart with the same checkpoint reads only what is new
    write(tmp_path / "in/9.jsonl", ['{"text": "new"}'])
    stream.read_corpus(spark, str(tmp_path / "in"), 1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13


def test_packing_state_outlives_a_batch(spark, tmp_path):
    schema = "g string, pos long, n long"
    for k in range(3):
        write(tmp_path / f"in/{k}.json", [json.dumps({"g": "a", "pos": 3 * k + x, "n": 8}) for x in range(3)])
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream.pack_stream(src, "g", "pos", "n", 40, 99).writeStream.format("memory").queryName("packed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # four documents of 8 + 2 fit a window of 40; nine documents close two windows
    assert [(r.window_no, r.n_documents, r.used) for r in spark.table("packed").orderBy("window_no").collect()] == [(0, 4, 40), (1, 4, 40)]


def test_blend_streams_refuses_bad_weights(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        stream.blend_streams({"a": df}, {"b": 1.0})
    with pytest.raises(ValueError):
        stream.blend_streams({"a": df}, {"a": 0.0})
    assert stream.blend_streams({"a": df, "b": df}, {"a": 1.0, "b": 3.0}).agg(F.sum("weight")).first()[0] == 1.0


def test_streams_are_blended_by_draws(spark, tmp_path):
    a, b = (spark.range(6000).select(F.col("id").alias("k")) for _ in range(2))
    got = {r.source: r["count"] for r in stream.blend_streams({"a": a, "b": b.limit(3000)}, {"a": 1.0, "b": 1.0}, "k", {"a": 6000, "b": 3000}).groupBy("source").count().collect()}
    assert got["b"] == 3000 and abs(got["a"] - 3000) < 200
    quarter = stream.blend_streams({"a": a, "b": b}, {"a": 1.0, "b": 3.0}, "k")
    assert abs(quarter.filter("source = 'a'").count() - 2000) < 150 and quarter.exceptAll(stream.blend_streams({"a": a.repartition(5), "b": b}, {"a": 1.0, "b": 3.0}, "k")).isEmpty()


def test_changed_files_are_refused(spark, tmp_path):
    write(tmp_path / "in/a.jsonl", ['{"text": "x"}'])
    m = str(tmp_path / "manifest.json")
    assert stream.refuse_changes(spark, str(tmp_path / "in"), m) == 1
    write(tmp_path / "in/b.jsonl", ['{"text": "y"}'])
    assert stream.refuse_changes(spark, str(tmp_path / "in"), m) == 2
    write(tmp_path / "in/a.jsonl", ['{"text": "other"}'])
    with pytest.raises(ValueError, match="a.jsonl"):
        stream.refuse_changes(spark, str(tmp_path / "in"), m)

