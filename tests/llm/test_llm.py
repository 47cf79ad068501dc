"""Small cases of the text problems and comparisons with brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import leakage as L
from barloom.llm import packing as K
from barloom.llm import pairs as P
from barloom.llm import queries
from barloom.llm import residue as R
from barloom.llm.words import readings_apart, readings_of, words_of

# -- 4 -----------------------------------------------------------------------------------------------------------------------

ASK = "Compare AAA1B with BBB2C given the plant fire."
CASES = [
    (ASK, None, "empty"), (ASK, "  \n", "empty"), (ASK, "```json\n\n```", "empty"), (ASK, "<p></p>", "empty"), (ASK, "N/A", "empty"), (ASK, '""', "empty"), (ASK, '{"answer": ""}', "empty"), (ASK, "...", "empty"),
    (ASK, ASK.upper(), "copy"), (ASK, f"Q: {ASK}\nA:", "copy"), (ASK, f"> {ASK}", "copy"), (ASK, ASK.replace("the ", "") + " " + ASK, "copy"),
    (ASK, f"You asked: {ASK} The spread has widened by 9 basis points and looks stretched to most of the desk.", None),
    ("Answer buy, hold or sell for AAA1B, one word only.", "Buy", None), ("Answer buy, hold or sell for AAA1B, one word only.", "HOLD.", None),
    (ASK, "I'm sorry, but I can't help with that request.", "refusal"), (ASK, "Es tut mir leid, dazu kann ich keine Auskunft geben.", "refusal"), (ASK, "Je suis désolé, mais je ne peux pas répondre à cette demande.", "refusal"),
    (ASK, "I cannot rule out a further fall, but the margin should recover in the spring.", None), (ASK, "Unable to hold its level, the share slipped.", None),
    (ASK, "The margin should recover. The order bo", "truncated"), (ASK, "The margin should recover,", "truncated"), (ASK, '{"action": "buy", "reason": "The mar', "truncated"), (ASK, '```json\n{"a": 1}', "truncated"), (ASK, "The order book", "truncated"),
    (ASK, '{"action": "buy", "reason": "The margin (if any) should recover."}', None), (ASK, "- The margin should recover in the spring\n- Volume is low", None), (ASK, "The margin should recover (see below).", None),
    (ASK, "Die Marge dürfte sich erholen, sobald die Lager fallen, und das ist nicht im Preis.", "language"), (ASK + " Answer in German.", "Die Marge dürfte sich erholen, sobald die Lager fallen, und das ist nicht im Preis.", None),
    (ASK, '{"action": "buy", "reason": "La marge devrait se redresser quand les stocks passeront sous la moyenne."}', "language"), (None, "The margin should recover in the spring.", None), ("", "Die Marge dürfte sich erholen.", None),
]


def test_pairs(spark):
    df = spark.createDataFrame([(i, p, r, "timeout", "x") for i, (p, r, _) in enumerate(CASES)] + [(None, ASK, None, None, None)], "call_id long, prompt string, response string, error string, defect string")
    got = {r.call_id: r.defect for r in P.broken_pairs(df).collect()}
    wrong = [(i, CASES[i], got.get(i)) for i in range(len(CASES)) if got.get(i) != CASES[i][2]]
    assert not wrong
    assert P.broken_pairs(df.limit(0)).count() == 0


UNSEEN = [  # texts of other makers: rules, not the phrases and words of the test tables
    ("How do I bake rye bread?", "I am not in a position to advise on recipes.", "refusal"), ("How do I bake rye bread?", "Unfortunately I won't discuss food.", "refusal"), ("¿Cómo se hace el pan?", "No estoy autorizado para opinar sobre recetas.", "refusal"),
    ("Comment faire du pain ?", "Je ne souhaite pas vous conseiller sur ce point.", "refusal"), ("Wie backt man Brot?", "Dazu möchte ich mich nicht äußern.", "refusal"), ("Hoe bak je brood?", "Daar kan ik helaas geen advies over geven.", "refusal"),
    ("How do I bake rye bread?", "I can't say it too often: give the dough twelve hours.", None), ("How do I bake rye bread?", "Mix the flour with water, and leave it for a day.", None),
    ("How do I bake rye bread with X3DES?", "Mischen Sie das Mehl mit Wasser und lassen Sie es einen Tag lang an einem warmen Ort stehen.", "language"), ("Wie backt man Brot?", "O padeiro mistura a farinha com água, mas não põe sal até ao dia seguinte.", "language"),
    ("Comment faire du pain ?", "Meng het meel met water en laat het een dag lang op een warme plek staan.", "language"), ("How do I bake bread in D4DES?", "Mix it with the water of the day before, then wait until it has risen.", None),
]


def test_pairs_of_other_texts():
    refusals = P.automaton_of_refusals()
    assert [(p, r, d, got) for p, r, d in UNSEEN if (got := P.defect_of(p, r, refusals, 0.8, 0.5)) != d] == []


def test_suffix_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 2, len(a) + 1)}
        want = [any(tuple(b[i:j]) in runs for i in range(k + 1) for j in range(max(i + 2, k + 1), len(b) + 1)) for k in range(len(b))]
        assert P.SuffixAutomaton(tuple(a)).covered(b, 2) == want


def test_very_long_pair():
    text = "word " * 200_000
    assert P.defect_of(text, text, P.automaton_of_refusals(), 0.8, 0.5) == "copy"
    assert P.open_delimiters("(" * 100_000 + ")" * 100_000, False) == []


# -- 8 -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = ["river", "stone", "budget", "levy", "harbour", "minister", "clause", "vote", "Straße", "forêt"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))), "x") for i in range(300)]
    rows += [(1, rows[1][1], "x"), (None, "no id", "x"), (900, None, "x"), (901, "", "x"), (902, "levy " * 5000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string")


def test_packing(spark, corpus):
    caps = spark.createDataFrame([("s", 100), ("l", 1000), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    got = K.packed(corpus, caps, shard=60).toPandas()
    encode = K.tokenizer(K.VOCABULARY).encode_ordinary
    texts = [(r.doc_id, r.text or "") for r in corpus.collect()]
    for name, cap in (("s", 100), ("l", 1000)):
        g = got[got["container"] == name]
        assert g["tokens"].sum() == sum(len(encode(t)) for _, t in texts)
        size = g.groupby("bin")["tokens"].sum()
        assert size.max() <= cap and (g.groupby("bin")["bin_tokens"].first() == size).all()
        whole = g[g["part"] == 0].groupby("doc_id", dropna=False).size()
        assert whole.sum() == len(texts)  # every row, repeated and null ids too
        long = g[g["doc_id"] == 902].sort_values("part")
        assert long["start_token"].tolist() == [cap * k for k in range(len(long))] and len(long) == -(-len(encode("levy " * 5000)) // cap)
        assert (g[g["part"] > 0]["doc_id"] == 902).all() or name == "s"
        assert size.sum() / (cap * len(size)) > 0.97
    assert set(got["container"]) == {"s", "l"}


def test_packing_empty(spark, corpus):
    caps = spark.createDataFrame([("s", 100)], "container string, capacity_tokens int")
    assert K.packed(corpus.limit(0), caps).count() == 0


def test_index_scores_are_bm25():
    import math

    import numpy as np

    terms, counts = [np.array([1, 2]), np.array([2, 3]), np.array([], int)], [np.array([2, 1]), np.array([1, 1]), np.array([], int)]
    held = np.zeros(10, int)
    held[[1, 2, 3]] = [1, 2, 1]
    got = K.Shard(terms, counts, held, 3, 2.0).scores(0)
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    w = lambda n, tf, size: idf(n) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 2))
    assert got == pytest.approx([w(1, 2, 3) + w(2, 1, 3), w(2, 1, 2), 0])


# -- 9 -----------------------------------------------------------------------------------------------------------------------


def test_words():
    assert words_of("The Cha-\nrter, l’été; 3.5 well-known Straße") == ["the", "charter", "lete", "35", "wellknown", "strasse"]
    assert readings_of("one [Applause (loud)] two") == [["one", "applause", "loud", "two"], ["one", "two"]]


def test_leaks_in_a_long_stretch(spark):
    """A text that is made of nothing but items, longer than a row of tokens many times over: each item is found, wherever it lies in it."""
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe", "ra"]) + str(rng.randrange(40)) for _ in range(rng.randrange(12, 90)))) for i in range(60)]
    docs = [(1, " ".join(t for _, t in items) * 3), (2, items[7][1]), (3, " ".join(items[8][1].split()[:11])), (4, items[9][1] + " x " + items[9][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in L.leaks(df, it).collect()}
    assert got == brute_leaks(docs, items, L.WINDOW) and {(1, i) for i in range(60)} | {(2, 7), (4, 9)} <= got


def test_readings_in_one_pass_are_those_of_two():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1 .-'[](){}\n\u00e9\u0301") for _ in range(rng.randrange(1, 25)))
        one, two = readings_of(text), readings_apart(text)
        assert one == two or (len(two) == 2 and two[0] == two[1] and one == [two[0]]), text


def brute_leaks(docs, items, n):
    out = set()
    for i, t in items:
        w = words_of(t or "")
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for d, x in docs if x and any(tuple(r[k : k + n]) in grams for r in readings_of(x) for k in range(len(r) - n + 1))}
    return out


@pytest.mark.parametrize("chars", [L.BROADCAST_CHARS, 1])
def test_leaks_against_brute_force(spark, chars):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij")
    items = [(i, " ".join(word() + word() for _ in range(rng.randrange(5, 40)))) for i in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(80):
        words = [word() + word() for _ in range(rng.randrange(0, 60))]
        if d % 2:
            own = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(own))
            words[3:3] = own[a : a + rng.randrange(5, 30)]
        if d % 5 == 0 and len(words) > 8:
            words.insert(7, "[Hear, hear!]")
        docs.append((d, " ".join(words).upper() if d % 3 else ", ".join(words)))
    docs += [(900, None), (901, ""), (1, docs[1][1])]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in L.leaks(df, it, broadcast_chars=chars).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items, L.WINDOW) and got
    assert L.leaks(df.limit(0), it, broadcast_chars=chars).count() == 0
    assert L.leaks(df, it.limit(0), broadcast_chars=chars).count() == 0


# -- 10 ----------------------------------------------------------------------------------------------------------------------

SPEECH = "Madam Speaker, nobody in the valley believes that the harbour levy can wait another year. (Applause) The amendment is modest, and it deserves support."
RESIDUE = [
    "{{ speaker.name }} rose at noon.", "The ${district} bench agreed.", "I thank <MINISTER> for giving way.", "[INSERT PARTY] said so.", "The {vote_result} stands.", "Costs rose by ________ in a year.", "[TBC: date] was the day.", "@@figure@@ per cent", "__REDNER__", "SPEAKER_NAME (PARTY): SPEECH_TEXT",
    "Replace this paragraph.", "Lorem ipsum dolor sit amet, consectetur magna aliqua.", "Texte à venir.", "test test test test", "404 Not Found", "Internal Server Error. The transcript service was unable to complete your request.", "Please enable JavaScript to read the verbatim report.", "Ohne JavaScript kann der Text nicht dargestellt werden.",
    "Traceback (most recent call last):\n  File \"x.py\", line 3, in <module>", "Access denied.",
]
CLEAN = [
    "A server error in the valley must not decide who votes.", "I was told to enable JavaScript before I could even read the petition from the valley; is that access?", 'The form still says "insert name here", and families are asked to sign it!', "This bill is so vague that it might as well read lorem ipsum from start to finish.",
    'The site answered "404 not found" for a whole week, and tenants noticed.', "Clause 9 {sic} was read, and the words [as amended] were left in.", "The witness was named only as XX in the 2010 report.", "Hear, hear!", "The schedule runs: <a> 677 crowns, <b> 767 crowns, 100% of it for pensions.", "On item 4 [TRANSLATION] the member said it was modest.", "Access was denied to weavers at the gate.",
]


def test_residue(spark):
    texts = [*(f"{SPEECH} {r}" for r in RESIDUE), *RESIDUE, *(f"{SPEECH} {c} {SPEECH}" for c in CLEAN), *CLEAN, *[SPEECH] * 60, None, "", "x" * 3 + " speech " * 30_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "Access denied.", "x")], "doc_id long, text string, kind string")
    got = {r.doc_id: r.kind for r in R.residue(df).collect()}
    n = 2 * len(RESIDUE)
    assert [texts[i] for i in range(n) if i not in got] == []
    assert [texts[i] for i in got if i >= n] == []
    assert R.without_residue(df).count() == df.count() - n
    assert R.residue(df.limit(0)).count() == 0


def test_residue_is_the_same_in_a_larger_corpus(spark):
    """Counts of a corpus 100,000 times as large change nothing; nor does a sentence that only holds an exemplar's words become one."""
    own = ["Access to the hall was denied.", "It is to be confirmed by the chair.", "The page has moved on to the clerk."]
    texts = [*(f"{SPEECH} {r}" for r in RESIDUE), *RESIDUE, *(f"{SPEECH} {c}" for c in [*CLEAN, *own]), *own, *[SPEECH] * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = R.token_counts(df)
    assert {r.token: r.n for r in once.where("token in ('', 'lorem')").collect()} == {"": len(texts), "lorem": sum("lorem" in t.lower() for t in texts)}
    small = {(r.doc_id, r.kind, r.passages) for r in R.residue(df, counts=once).collect()}
    assert {d for d, *_ in small} == set(range(2 * len(RESIDUE))) and small == {(r.doc_id, r.kind, r.passages) for r in R.residue(df).collect()}
    assert small == {(r.doc_id, r.kind, r.passages) for r in R.residue(df, counts=once.withColumn("n", F.col("n") * 100_000)).collect()}


@pytest.mark.parametrize("page", ["404 Not Found", "The page you requested could not be found.", "Please enable JavaScript to read the verbatim report.", "Lorem ipsum dolor sit amet, consectetur magna aliqua.", "Texte à venir."])
@pytest.mark.parametrize("share", [3, 10])
def test_residue_that_is_common(spark, page, share):
    """One page that makes up a third of the documents (or a tenth) is found in each of them; speeches and initials aren't."""
    texts = [page if i % share == 0 else f"{SPEECH} N. Smith spoke on item {i}. {CLEAN[i % len(CLEAN)]}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in R.residue(df).collect()} == set(range(0, 600, share))


@pytest.mark.parametrize(
    "field",
    ["{{ speaker.name | default('the honourable member for the district named in the header') | title }}", '{{ speaker |\n default("{unknown}") }}', "{% if sitting.date is defined and sitting.date is not none and speaker.name %}", "<% if votes.for > votes.against && sitting.speaker.name != null\n then %>", "${speaker.name:-the honourable member for the district that is named in the header}", "{{ don't }}"],
)
def test_long_fields(field):
    assert R.masked(f"{SPEECH} {field} it isn't {SPEECH}") == f"{SPEECH}  {R.FIELD}  it isn't {SPEECH}"


def test_open_marks_are_no_fields_and_take_no_time():
    for text in ("{{ " * 20_000, "{% " * 20_000, "<% " * 20_000, "${ " * 20_000, "{{ a's " * 20_000, "{" * 50_000, "{{1,2},{3,4}}", "rose by 5% {sic} <b>"):
        assert R.FIELD not in R.masked(text)


def test_queries(spark, sf):
    for name, q in queries.QUERIES.items():
        got = q(spark, sf)
        assert got.count() > 0, name
    assert dict(queries.p4_found(spark, sf).dtypes) == {"call_id": "bigint", "defect": "string"}
    assert dict(queries.p9_found(spark, sf).dtypes) == {"doc_id": "bigint", "item_id": "bigint"}
    assert dict(queries.p10_found(spark, sf).dtypes) == {"doc_id": "bigint"}
    assert isinstance(queries.p4_found(spark, sf).orderBy("call_id").agg(F.count_distinct("call_id")).toPandas(), pd.DataFrame)
