from __future__ import annotations

import random
from datetime import datetime, timedelta

from lodestone.llm import pair_defects as P
from lodestone.llm.langid import LanguageModel

M = "id string, conversation_id string, role string, text string, created_at timestamp"
EN = ["The lamp is not bright and the glass of the pump was cleaned.", "Please open the side cover and wait for the green light to come on.", "When the pump has run for an hour, close the lower tap and write down the pressure."]
DE = ["Die Lampe ist nicht hell und das Glas der Pumpe wurde heute gereinigt.", "Bitte öffnen Sie den Deckel und warten Sie auf das grüne Licht.", "Wenn die Pumpe eine Stunde gelaufen ist, schließen Sie den unteren Hahn."]


def documents(spark):
    rows = [(i, f"{t} {t}", lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] * 6 + [(t, "de") for t in DE] * 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def found(spark, pairs):
    rows = []
    for n, (q, a) in enumerate(pairs):
        at = datetime(2025, 1, 1) + timedelta(minutes=n)
        rows += [(f"q{n}", f"c{n}", "user", q, at), (f"a{n}", f"c{n}", "assistant", a, at + timedelta(seconds=1))]
    got = {r["message_id"]: r["defect"] for r in P.defects(spark.createDataFrame(rows, M), documents(spark)).collect()}
    return [got.get(f"a{n}") for n in range(len(pairs))]


def test_defects(spark):
    q = "Is the glass of the pump clean and the lamp bright?"
    pairs = [
        (q, "N/A"), (q, None), (q, "“Is the glass of the pump clean and the lamp bright?”"), (q, "Question: " + q), (q, DE[0]), (q + " Please answer in German.", DE[0]),
        (q, EN[0]), (q, "I am sorry, but I cannot help with that. Please call your branch."), (q, "I'm sorry for the trouble: the lamp is loose, so tighten it."),
        (q, EN[0] + " When the pump has"), (q, "1. Open the cover\n2. Close the tap\n3."), (q, "21 months"), (q, "Yes"), (q, "- open the side cover"),
        (q, "Close the lower tap, then,"), (q, "The manual e.g."), ("Ist das Glas der Pumpe sauber und hell?", "Ich kann diese Frage leider nicht beantworten."),
        (q, "We do not allow a longer pipe; keep it below 3 metres and close the tap."),
    ]
    assert found(spark, pairs) == [
        "empty", "empty", "copy", "copy", "language", None, None, "refusal", None, "truncated", "truncated", None, None, None, "truncated", "truncated", "refusal", None,
    ]


def read(spark, rows, parts=None):
    """(id, sure) of the pairs of message rows, read in ``parts`` partitions of the sorted turns."""
    model = LanguageModel.fit([(t, "en") for t in EN] * 3 + [(t, "de") for t in DE] * 3)
    turns = P.ordered_turns(spark.createDataFrame(rows, M))
    if parts:
        turns = turns.coalesce(1).rdd.zipWithIndex().map(lambda r: (r[1], tuple(r[0]))).collect()
        schema = "conversation_id string, later int, id string, text string, nothing boolean"
        turns = spark.createDataFrame(spark.sparkContext.parallelize([r for _, r in sorted(turns)], parts), schema)
    first = P.read_pairs(turns, model)
    return {r["id"]: r["sure"] for r in first.unionByName(P.adopted(first, model)).filter("kind = 'pair'").collect()}


def test_pairs_take_the_last_question_and_need_one(spark):
    at = [datetime(2025, 1, 1) + timedelta(seconds=i) for i in range(6)]
    q = "Is the lamp not bright?"
    rows = [("a0", "c", "ai", q, at[0]), ("q1", "c", "user", q, at[1]), ("a1", "c", "ai", q, at[2]), ("a2", "c", "ai", q, at[3]), ("q2", "c", "user", EN[1], at[4]), ("a3", "c", "bot", EN[1], at[5]), ("a4", None, "ai", q, at[5])]
    for parts in (None, 1, 2, 3, 6):
        assert read(spark, rows, parts) == {"a1": "copy", "a2": "copy", "a3": "copy"}, parts


def test_questions_of_earlier_parts(spark):
    """One question, and answers over many partitions; a conversation that begins with answers has no pair."""
    at = datetime(2025, 1, 1)
    rows = [("q", "c", "user", EN[0], at)] + [(f"a{i:02}", "c", "ai", EN[0], at + timedelta(seconds=i + 1)) for i in range(20)]
    rows += [(f"b{i}", "d", "ai", EN[0], at + timedelta(seconds=i)) for i in range(5)]
    for parts in (1, 4, 9, 26):
        assert read(spark, rows, parts) == {f"a{i:02}": "copy" for i in range(20)}, parts


def test_only_a_direct_answer_has_the_question_s_language(spark):
    at = datetime(2025, 1, 1)
    rows = [("q", "c", "user", EN[2], at), ("a1", "c", "ai", DE[2], at + timedelta(seconds=1)), ("a2", "c", "ai", DE[2], at + timedelta(seconds=2))]
    for parts in (1, 2, 3):
        assert read(spark, rows, parts) == {"a1": "language", "a2": None}, parts


def test_templates_across_prompts(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    base, near, other = " ".join(words), " ".join([*words[:-1], "other"]), "what ever else is said here today"
    rows = [(base, 1, 1), (base, 2, 1), (near, 3, 0), (other, 4, 0), (other, 5, 0), ("said once only", 6, 1), ("said once fully", 6, 2), ("said twice to one", 7, 1), ("said twice to one", 7, 1)]
    df = spark.createDataFrame(rows, "opening string, prompt long, evidence int")
    assert {r["opening"] for r in P.refusal_templates(df).collect()} == {base, near, "said once fully"}


def test_evidence():
    said = {
        "I'm sorry, but I can't help with that.": 2, "The question cannot be answered.": 1, "If this does not help, call us.": 0, "The belt is not covered.": 0,
        "Ich kann diese Frage leider nicht beantworten.": 2, "Bu konuda yardımcı olamam.": 2, "我无法回答这个问题": 2, "Main is mein madad nahi kar sakta": 2, "Mera tank kharab hai aur hawa nahi aa rahi": 0,
    }
    assert {s: P.evidence(P.words_of(s)) for s in said} == said


def test_statement():
    def of(text):
        return P.statement(text, P.sentences_of(text))[1:]

    assert of("Hello! I am unable to answer this. Please call your branch.") == (2, False)
    assert of("I am unable to answer this. Open the lower tap.") == (2, True)
    assert of("I cannot answer that: open the lower tap") == (2, True)
    assert of("Sorry to hear that. First open the tap.") == (0, False)


def test_gram_counts():
    c = P.GramCounts()
    c.add(P.sentences_of("Open the tap. Close the tap now"))
    c.pack()
    c.add(P.sentences_of("the tap"))
    got = {g: tuple(r) for g, *r in c.rows()}
    assert got[P.gram(["the", "tap"], 2)] == (3, 1, 1) and got[P.gram(["tap"], 1)] == (3, 1, 1) and got[P.gram(["now"], 1)] == (1, 0, 1)
    assert got[P.gram(["ta"], 0)] == (3, 0, 0) and P.gram(["tap", "close"], 2) not in got and c.rows() == []


def test_bands_meet():
    a = " ".join(f"w{i}" for i in range(40))
    b = a.replace("w39", "x")
    assert set(P.bands(a)) & set(P.bands(b)) and P.bands(a) == P.bands(a) and not set(P.bands(a)) & set(P.bands("quite another thing"))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], M)
    assert P.defects(empty, documents(spark)).count() == 0


def test_a_template_s_members_follow_it(spark):
    """The wording that shows no evidence is a refusal only through the verified group of those that do."""
    before = "Dealers in your town hold all papers about every machine ever sold by us since they opened and so explain each of them over coffee while such talk here by mail for years has been found to"
    listed, other = f"{before} exceed the scope.", f"{before} leave the yard."
    assert P.evidence(P.words_of(other)) == 0 and len(before.split()) == 37
    assert found(spark, [("Why is it so loud?", listed), ("Where can one buy salt?", listed), ("How old is mine?", other)]) == ["refusal"] * 3
    assert found(spark, [("How old is mine?", other), ("Where can one buy salt?", other)]) == [None] * 2


def test_templates_without_the_least_opening(spark):
    """The least opening of a bucket is like no other, and the third one like the second only."""
    words = [f"w{i}" for i in range(40)]
    least = " ".join(["9 " * 6 + "_", *words[12:]])
    second = [*words[:37], "x", "x", "x"]
    chain = [" ".join(words), " ".join(second), " ".join(["y", "y", "y", *second[3:]])]
    rows = [(least, 9, 0), (chain[0], 1, 1), (chain[1], 2, 1), (chain[2], 3, 0)]
    df = spark.createDataFrame(rows, "opening string, prompt long, evidence int")
    assert {r["opening"] for r in P.refusal_templates(df).collect()} == set(chain)


def test_bucket_links_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") for _ in range(40)] for _ in range(6)]
    members = []
    for k in rng.sample(range(1000), 160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = rng.choice("xyz")
        members.append((k, " ".join(w[: rng.randint(30, 40)])))
    sets = {k: P.shingles(o) for k, o in members}
    all_pairs = [(max(x, y), min(x, y)) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    group = {k: k for k in sets}
    for _ in sets:
        for x, y in all_pairs:
            group[x] = group[y] = min(group[x], group[y])
    want = {(k, g) for k, g in group.items() if k != g}
    assert len({g for _, g in want}) > 3 and set(P.bucket_links(members, 0.8)) == want
    links = spark.createDataFrame(all_pairs, "a long, b long")
    assert {tuple(r) for r in P.components(links).collect()} == want
    assert P.components(links.filter("false")).count() == 0
