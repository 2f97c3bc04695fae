import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import pii, quality, spam
from loomtext.llm.handchecked import CHUNKS

CHUNK = "chunk_id long, text string, source_id string"
GIVEN = ["Anna", "Tom", "Will", "Mark", "Rose"]
PROSE = [
    "The keeper of the old tower went down to the harbour in the morning and saw that the boats had not come back.",
    "If the bread is too dry, then it was in the oven for too long, and there is nothing that you can do about it.",
    "Nobody in the town knew why the bell had rung, but all of them had heard it twice in the night.",
    "When the rain stopped, the children ran out of the house and looked for the cat under the hedge.",
    "It was the third of the letters that she had kept in the drawer, and she read it again by the window.",
    "He asked for the key, because the door to the garden was closed and the others were still outside.",
]
JUNK = [
    "a1;b2;33.5;Kerby\nc3;d4;17.2;Marston\ne5;f6;98.1;Kerby", "- nail\n- screw\n- bolt\n- hook\n- hinge", "2031-01-02T10:11Z INFO w[3] k=7\n2031-01-02T10:12Z WARN w[3] k=9", "Home | Shop | Help | Login\nTools | Saws | Planes", "xkcd wrtz pqmn\nbvcx trqp mnbv\nwrtp kjhg",
    "q83hFz0LmQ2vTnYp7sWkXcRb1uJdGe5oA9iHtN4yQw\nZx6VrMlP0qKsTgBw2EfUjYhCn8DaOi3kLm7pQrStUv", "{{{{ //// ]]]] $$$$ x ~~~~\n%%%% #### ^^^^ ||||", "Ã¶Ã¤â€™ Ã�Ã¶ €€ƒ ¶¶Ã� q\n™™â€ Ã¤Ã¶Ã¼ x ƒ�¶", "width: 30 cm\nheight: 12\ncolour: red\nstock: yes",
    "sale sale SALE sale!\nsale, cheap sale", "- the old hammer\n- a small plane\n- the other saw\n- one long rasp", "kettle     3    14.99\npan        1    29.50"]


@pytest.fixture(scope="module")
def quality_model():
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.sample(PROSE, rng.randint(1, 4))) for _ in range(300)] + ["\n".join(rng.sample(x.split("\n"), rng.randint(1, len(x.split("\n"))))) + "\n" + x for x in JUNK for _ in range(25)]
    x, y = quality.training_set(texts, 600)
    hand = np.array([quality.statistics(t) for t, _ in CHUNKS])
    return quality.BoostedTrees().fit(x, y).calibrate(hand, np.array([v for _, v in CHUNKS], float))


def test_quality_on_the_hand_checked_chunks(quality_model):
    p = quality_model.probability(np.array([quality.statistics(t) for t, _ in CHUNKS]))
    assert np.mean((p > 0.5) == np.array([v == 1 for _, v in CHUNKS])) >= 0.9


def test_quality_statistics():
    s = dict(zip(quality.FEATURES, quality.statistics("The cat sat.\nThe dog ran")))
    assert s["word_count"] == 6 and s["mean_word_length"] == 3 and s["end_punct_share"] == 0.5 and s["common_word_share"] == pytest.approx(2 / 6)
    assert s["symbol_ratio"] == pytest.approx(1 / 19)
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * len(quality.FEATURES)


def test_quality_edges(spark, clashing, quality_model):
    rows = [(1, None, "a"), (2, " ", "a"), (3, "word " * 200_000, "a"), (4, PROSE[0], None), (4, PROSE[0], None), (5, JUNK[0], "A-b")]
    df = clashing(spark.createDataFrame(rows, CHUNK))
    got = {r.chunk_id: r for r in quality.text_quality(df.drop("p", "word_count"), model=quality_model).collect()}
    assert got[1].word_count == 0 and got[1].junk_probability is None and not got[2].is_junk and got[5].is_junk and not got[4].is_junk
    assert quality.text_quality(df.limit(0)).count() == 0
    spec = spark.createDataFrame([("a_b", (False, True, False)), ("a", (False, False, False)), (None, None)], "source_id string, pipeline struct<strip_markup: boolean, quality: boolean, mask_pii: boolean>")
    assert [r.chunk_id for r in quality.quality_switched(df, spec).collect()] == [5]


@pytest.fixture(scope="module")
def spans():
    import random

    rng = random.Random(2)
    family = ["Brannock", "Fallerby", "Quillow", "Pembwicke", "Torrander"]
    frames = ["Contact: {n}, {p}.", "The form was signed by {n}, {a}, Kerby.", "{n} | {m} | {p}", "She gave her SSN {i} at the desk.", "Please write to {m} or call {p}.", "{n} said the key was with the clerk.", "Ms {n} said the key was with the clerk.", "Contact: Dr. {n}, {p}.", "Witness: {n}; SSN {i}", "According to {n}, the list was never sent.", "According to {r}, the list was never sent.", "{r} | {m} | {p}"]
    texts = []
    for k in range(900):
        n = f"{rng.choice([*GIVEN, 'Nora', 'Lyle'])} {rng.choice(family)}"
        p = rng.choice([f"+1 555 555 01{rng.randint(10, 99)}", f"(555) 555-01{rng.randint(10, 99)}", f"020 7946 0{rng.randint(100, 999)}"])
        t = rng.choice(frames).format(n=n, r=", ".join(reversed(n.split())), p=p, a=f"{rng.randint(1, 99)} Mill Road", m=f"{n.split()[1].lower()}@post.example", i=f"9{rng.randint(10, 99)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}")
        texts.append(f"{rng.choice(PROSE)} {t} Order 6968-26-3577 left. {rng.choice(PROSE)}")
    texts += PROSE * 20 + ["We mark the rose and will see. Tempo Mark | String Section | Copper Bow"] * 20
    # capitals that are no names, as menus, titles and places have them
    places = ["Kerby", "Marston", "Holby", "Orford", "Dunmere", "Pelwold"]
    things = ["Plane Iron", "Saw Blade", "Oak Board", "Valley Road", "Ticket Office", "Census Roll", "History File", "Fog Layer"]
    for _ in range(300):
        texts.append(f"{rng.choice(things)} | {rng.choice(places)} | {rng.choice(things)} » {rng.choice(things)}\nSee {rng.choice(places)} Harbour Council, minutes of 11 May. We ordered 34 Oak Lane chairs for {rng.choice(places)} Hall.")
        texts.append(" ".join(rng.sample(things, 2)).lower() + " " + rng.choice(PROSE))
    return pii.train_on(texts, GIVEN)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Please write to a.berg+x@mail.example or call (555) 555-0123.", [("email", "a.berg+x@mail.example"), ("phone", "(555) 555-0123")]),
        ("Contact: Anna Brannock, +1 555 555 0144.", [("name", "Anna Brannock"), ("phone", "+1 555 555 0144")]),
        ("According to Quillow, Nora, the list was never sent.", [("name", "Quillow, Nora")]),
        ("Dr. Tom Fallerby said the key was with the clerk.", [("name", "Tom Fallerby")]),
        ("She gave her SSN 914-55-3453 at the desk.", [("identity", "914-55-3453")]),
        ("The form was signed by Will Torrander, Flat 3, 12 Mill Road, Kerby.", [("name", "Will Torrander"), ("address", "Flat 3, 12 Mill Road")]),
        ("Mail jo [at] post [dot] example today.", [("email", "jo [at] post [dot] example")]),
        ("Install @kell/core and pike@4.9.8 together. Follow @dune_edit for updates.", []),
        ("Order 6968-26-3577 left the depot on 2031-07-19. The address 192.0.2.140 no longer answers.", []),
        ("Upgrade to version 73.9.312 before the next release.", []),
        (PROSE[0], []),
        ("", []),
        (None, []),
    ],
)
def test_spans(spans, text, want):
    assert [(k, text[a:b]) for k, a, b in spans.spans(text)] == want


def test_positions_and_masks(spark, clashing, spans):
    rows = [(1, "Ωmega 😀 Contact: Anna Brannock, +1 555 555 0144.", None), (1, "Ωmega 😀 Contact: Anna Brannock, +1 555 555 0144.", None), (2, None, None), (3, " ", None), (4, "word " * 100_000, None)]
    df = clashing(spark.createDataFrame(rows, CHUNK)).drop("start_pos")
    given = spark.createDataFrame([(g, "en") for g in GIVEN] + [(None, None)], "given_name string, lang string")
    got = {tuple(r) for r in pii.find_personal(df, given, model=spans).collect()}
    assert got == {(1, "name", 17, 30), (1, "phone", 32, 47)}
    masked = {r.chunk_id: r.text for r in pii.mask_personal(df, given, model=spans).collect()}
    assert masked[1] == "Ωmega 😀 Contact: <NAME>, <PHONE>." and masked[2] is None and masked[3] == " "
    assert pii.find_personal(df.limit(0), given).count() == 0


def test_lexicons_rest_on_all_chunks(spark):
    from loomtext.plans.lineage import hash_sample

    family = ["Brannock", "Fallerby", "Quillow", "Pembwicke", "Torrander"]
    frames = ["{p} Contact: {n}, +1 555 555 0144.", "Ms {n} said so. {p}", "Plane Iron | Kerby Road | Saw Blade » Fog Layer\n{p} See Holby Hall.", "{p} Oak Board | Census Roll | Valley Road."]
    texts = [frames[k % 4].format(p=PROSE[k % 6], n=f"{GIVEN[k // 4 % 5]} {family[k // 20 % 5]}") for k in range(600)]
    sample = {r[0] for r in hash_sample(spark.range(600), "id", 100).collect()}
    rest = [k for k in range(600) if k not in sample]
    for k, f in zip(rest, family):
        texts[k] = f"{PROSE[0]} Contact: Ysolde {f}, +1 555 555 0144. He sold some tillwort."
    reversed_at = rest[10]
    texts[reversed_at] = f"{PROSE[1]} According to Quillow, Ysolde, the list was never sent."
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[rest[0]], rows[rest[0]], (None, "tillwort Mae Tillwort", "a"), (601, None, "a")], CHUNK)
    given = spark.createDataFrame([(g, "en") for g in GIVEN], "given_name string, lang string")
    model = pii.train(df, given, train_chunks=100)
    assert "ysolde" in model.lex.induced_given
    start = texts[reversed_at].index("Quillow")
    assert ("name", start, start + len("Quillow, Ysolde")) in model.spans(texts[reversed_at])
    # by grouped sums or in one list: the same, and repeated rows once
    whole, counts = pii.Counts(texts), pii.TableCounts(df, "chunk_id")
    got = counts.n.collect()
    assert {(r.g, r.f, r.before, r.bits): r.n for r in got if r.kind == "n"} == dict(whole.names)
    assert {r.g: r.n for r in got if r.kind == "w"} == dict(whole.words)
    assert counts.common() == {w for w in whole.common() if any(w in r[1].split("-") for r in whole.names)}
    judge = pii.Judge(model.lex, pii.LabelModel().fit(np.array([[1] + [0] * 10, [0] * 4 + [-1] + [0] * 6])))
    assert counts.induced(judge) == whole.induced(judge)


def test_gazetteer_of_any_size(spark):
    """Beyond the bound only names that occur are brought in; what they say about the texts is the same."""
    texts = [f"{PROSE[k % 6]} Contact: {GIVEN[k % 5]}-Lou Quillow, +1 555 555 0144." for k in range(40)]
    df = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], CHUNK)
    given = spark.createDataFrame([(g,) for g in [*GIVEN, "'Lou’", "Absent", None] + [f"N{k}" for k in range(50)]], "given_name string")
    counts = pii.TableCounts(df, "chunk_id")
    assert set(pii.gazetteer(given, counts, most=10)) == {*GIVEN, "'Lou’"} and len(pii.gazetteer(given, counts)) == 57


def test_reversed_names_without_a_known_given_name_stay_candidates():
    lex = pii.Lexicon(frozenset({"anna"}), frozenset(), frozenset({"nora"}), frozenset({"quillow"}))
    got = [c for c in pii.candidates("According to Quillow, Ysolde, it was late.", lex) if c.kind == "name"]
    assert [(c.start, c.votes[-1]) for c in got] == [(13, -1)]
    label = [c for c in pii.candidates("She lives in der Nähe, Anschrift: Alte Gasse 149.", lex) if c.kind == "name"]
    assert [sum(c.votes) for c in label] == [-1]


def test_label_model_learns_who_is_reliable():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    noisy = lambda acc, fire: np.where(rng.random(4000) < fire, np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1)), 0)
    votes = np.stack([noisy(0.95, 0.6), noisy(0.9, 0.7), noisy(0.55, 0.9)], axis=1)
    q = pii.LabelModel().fit(votes).posterior(votes)
    sure = (votes[:, :2] != 0).any(axis=1)
    assert np.mean((q > 0.5)[sure] == y[sure]) > 0.9


SPAM = [
    "[best saw](http://a-shop.example/x) - [cheap plane](https://b-shop.example/y?id=4)\n[top rasp](http://c-shop.example/) - [buy clamp](http://d-shop.example/z)",
    "best saw Kerby; cheap saw Marston, top saw Holby\nbuy saw Kerwold\nlocal saw Dunby; online saw Pelmere\nfree saw Orford",
    "Tags: best-saw | cheap-plane, top-rasp | buy-clamp, local-chisel | free-square",
    "Want top saw? Get top saw with top saw today. Our top saw is the top saw for top saw fans. top saw and top saw, only top saw!",
    "SKU 24879 saw red XL 15.99 / SKU 29804 saw new 49.99\nRef 69141 saw size 4 92.99 / Art. 6716 saw XL 71.99",
    "#bestSaw #cheapPlane #topRasp #buyClamp #localChisel #freeSquare #bestHook",
]
HAM = [
    *PROSE,
    "def saw(a, b):\n    return [a[k] for k in range(b) if k % 7]\n@cached\ndef plane(self):\n    return self.saw",
    "# tool\n> Packs the files of a folder.\n- Pack a folder:\n`tool -c x`\n- Unpack it:\n`tool -x y`",
    " ".join(PROSE) + "\nReferences\n[1] http://a.example/x\n[2] http://b.example/y",
    "The river runs and runs away,\nand no one knows where it will stay.\nThe river runs and runs away,\nand takes the colour of the day.\nThe river runs and runs away,\nand we shall follow it some day.",
    "Saw: a tool that cuts the wood with its teeth.\nPlane: a tool that makes the surface of the wood even.\nRasp: a rough file for the shaping of wood.",
]


#: Prose in more shapes than whole sentences on one line: verse, definitions, lines that run on.
SHAPES = [
    "The road goes up and over the hill,\nand all of the houses behind it are still.\nThe moon is above and the valley below,\nand no one can tell where the travellers go.",
    "Lamp: a thing that gives light when the day has gone.\nBasket: a woven thing that holds the bread or the wool.\nLadder: two long poles with steps between them, for the roof.",
    "You can keep the flour in a box,\nwhich should stand in a dry place,\nor in a bag on the shelf.",
    "Bring the water to the boil and add the salt. Wait for a while. Then put the beans into it, and stir.",
    "Is there a better way? Perhaps, but nobody has found it so far, and we have no time to look for one.",
    "There were three of them in the boat, a tall man, a short man and a dog that could not swim.",
    "The bell of the tower is old, and the bell is the only thing that the town took from the fire. They say that it was in the river for a year,"
    "\nand that the bell was heard from there in the night. When we were small we went to see it with our father, who told us that it had no name;"
    "\nbut he knew every bell in the valley, and we did not, so we said nothing and walked home.",
    "What is a knot? It is a way to tie two ends, and a good knot can be undone again.",
]


def test_calibration_on_sampled_chunks(quality_model):
    """Chunks that were sampled, labelled by reading and never fitted: Brier score, and probabilities that agree with the shares of junk."""
    brier, bands = quality.holdout_report(quality_model)
    assert brier < 0.03
    assert sum(n for n, _, _ in bands) == 31 and all(abs(p - y) < 0.25 for n, p, y in bands if n >= 5)


def test_spam_needs_the_model():
    """The perplexity decides: with its range opened, ordinary pages are flagged too, and with an endless one nothing is."""
    model = spam.SequenceModel((PROSE + SHAPES) * 20)
    flagged = lambda: sum(model.shares(t)[0] > 0.5 for t in SPAM + HAM)
    assert flagged() == len(SPAM)
    high, model.high = model.high, -1.0
    assert flagged() >= len(SPAM) + len(HAM) - 2
    model.low, model.high = 0.0, 1e9
    assert flagged() == 0 and 2 < high < 9


def test_spam(spark, clashing):
    model = spam.SequenceModel((PROSE + SHAPES) * 20)
    rows = [(k, t) for k, t in enumerate(SPAM + HAM)] + [(100, None), (101, " "), (102, "saw " * 100_000)]
    got = {r.doc_id: r.is_spam for r in spam.spam_pages(clashing(spark.createDataFrame(rows, "doc_id long, text string")), model).collect()}
    assert [got[k] for k in range(len(SPAM))] == [True] * len(SPAM)
    assert [got[len(SPAM) + k] for k in range(len(HAM))] == [False] * len(HAM)
    assert not got[100] and not got[101] and got[102]
    assert spam.spam_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spam_model_of_all_documents(spark):
    """Counts and range rest on every document, repeated rows once; by grouped sums or in one list, the model is the same."""
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.sample(PROSE, rng.randint(1, 4))) for _ in range(5000)] + SHAPES * 3 + SPAM * 3 + HAM
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, *rows[:50], (9000, None)], "doc_id long, text string").repartition(3)
    whole, got = spam.SequenceModel(texts), spam.train_model(df)
    assert np.array_equal(got.keys, whole.keys) and np.allclose(got.more, whole.more, rtol=1e-12)
    assert (got.low, got.high) == pytest.approx((whole.low, whole.high), rel=1e-12)
    plain = spark.createDataFrame([(k, t) for k, t in rows[:300]], "doc_id long, text string")  # no page is spam at first sight
    assert spam.train_model(plain).high == pytest.approx(spam.SequenceModel(texts[:300]).high, rel=1e-12)


def test_spam_range_holds_when_a_few_pages_are_odd():
    """A few odd ordinary pages and the choice of the spam at first sight don't move the range over other spam."""
    import random

    rng = random.Random(7)
    prose = [" ".join(rng.sample(PROSE, rng.randint(1, 4))) for _ in range(1500)] + SHAPES * 20
    places = [a + b for a in ("Ker", "Mars", "Hol", "Dun", "Pel", "Or") for b in ("by", "ton", "wold", "mere", "ford")]
    keywords = ["\n".join(f"{a} {t} {b}; {c} {t} {d}" for a, b, c, d in zip(rng.choices(["best", "cheap", "top", "online"], k=8), rng.choices(places, k=8), rng.choices(["buy", "free", "local"], k=8), rng.choices(places, k=8))) for t in ("saw", "lathe", "clamp", "rasp") * 10]
    tags = [" ".join(f"#{rng.choice(['best', 'cheap', 'top'])}{rng.choice(places)}" for _ in range(20)) for _ in range(40)]
    # pages of code with a few other lines, and some that no class marks and that are more unusual than spam
    code = ["\n".join(f"@cached\ndef plane_{k}(self):\n    return self.saw_{k}" for k in range(n, n + 6)) for n in range(8)]
    odd = ["\n".join(f"{k}x{n} {n}y{k} z{k}{n} | {k}-{n} | {n}%" for k in range(12)) for n in range(6)]
    for extra in ([], code, odd, code + odd):
        model = spam.SequenceModel(prose + keywords + tags + extra)
        assert all(model.shares(t)[0] > 0.5 for t in keywords + tags)
        assert not any(model.shares(t)[0] > 0.5 for t in prose + code)
    labels = [{spam.read_page(t).label for t in x} for x in (odd, keywords, tags)]
    assert labels == [{0}, {-1}, {1}]


def test_queries_run_without_caps(spark):
    from loomtext.llm import queries

    assert {f"p{n}_found" for n in range(1, 9)} <= set(queries.QUERIES)
    assert F is not None
