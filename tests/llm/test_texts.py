from __future__ import annotations

import itertools
import random
import textwrap
import unicodedata

import numpy as np

from lodestone.llm import langid, leakage, line_model, markup, markup_pages, ocr_repair

CLEAN = [
    "Keep the lamp away from open windows and clean the glass with a dry cloth after each use.",
    "When the pump has run for 12 minutes, close the lower tap and wait until the pressure falls.",
    "The engineer found that two bolts were missing, which explains the heavy rattling near the high-voltage box.",
]


# --- scanned pages ---------------------------------------------------------------------------------------------------------------


def test_line_model_on_held_out_pages():
    pages = line_model.labelled_pages(200, seed=99)
    decoded = [line_model.line_model().decode([x for x, _ in p]) for _, p in pages]
    pairs = [(s, g) for (_, p), (_, states) in zip(pages, decoded, strict=True) for (_, s), g in zip(p, states, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.99
    assert sum(k == got for (k, _), (got, _) in zip(pages, decoded, strict=True)) / len(pages) > 0.97


def test_wide_pages_are_scanned_as_well():
    prose = "The left handle turns the inner ring, whereas the right one only locks it and must never be forced by anybody who has not read the whole of this page "
    for width in (60, 100, 150, 200):
        text = "\n".join(textwrap.wrap(prose * 8, width))
        assert ocr_repair.label_lines(text)[0], width
    assert not ocr_repair.label_lines("\n\n".join([prose.strip() + "."] * 5))[0] and not ocr_repair.label_lines(prose)[0]
    assert line_model.line_model().decode([]) == ("other", [])


def test_repeated_rows_count_once(spark):
    """A word that stands in one chunk, given twice, is no word of two chunks."""
    page = "Keep the lamp away from open win-\ndows and clean the glass with a\ndry clotb after each use and then\nlet it stand for the whole night."
    rows = [("a", "A cloth is dry."), ("a", "A cloth is dry."), *[(f"c{i}", CLEAN[1]) for i in range(3)], ("s", page)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert ("misread", "cloth") not in {(r["kind"], r["piece"]) for r in ocr_repair.scan_repairs(df).collect()}
    more = df.union(spark.createDataFrame([("b", "The cloth.")], df.schema))
    assert ("misread", "cloth") in {(r["kind"], r["piece"]) for r in ocr_repair.scan_repairs(more).collect()}


def test_repairs(spark):
    page = "Keep the lamp away from open win-\ndows and clean the glass with a\nPage 12\n\nNORLAN OWNER MANUAL   13\ndry clotb after each use. The high-\nvoltage box has a pressurc gauge\nand heavy rattl\xad\ning was heard near the lowcr tap."
    rows = [(f"c{i}", t + " The lower pressure and rattling cloth windows.") for i, t in enumerate(CLEAN * 3)] + [("s", page), ("s", page), ("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    got = {tuple(r) for r in ocr_repair.scan_repairs(df).collect()}
    assert got == {
        ("s", "hyphen", "windows"), ("s", "hyphen", "high-voltage"), ("s", "hyphen", "rattling"), ("s", "pagenum", "Page 12"), ("s", "header", "NORLAN OWNER MANUAL   13"),
        ("s", "misread", "cloth"), ("s", "misread", "pressure"), ("s", "misread", "lower"),
    }
    text = [r["paragraph"] for r in ocr_repair.repair_scanned(df).filter("chunk_id = 's'").orderBy("paragraph_no").collect()]
    assert text == ["Keep the lamp away from open windows and clean the glass with a dry cloth after each use. The high-voltage box has a pressure gauge and heavy rattling was heard near the lower tap."]


def test_values_on_lines_are_no_page_numbers():
    text = CLEAN[0] + "\n\nTorque (Nm)\n47\nSpeed (rpm)\n1200"
    assert ocr_repair.read_page(text)[1] == []


def test_nothing_scanned(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert ocr_repair.scan_repairs(df).count() == 0


def test_candidates():
    for seen, true in (("mlnutes", "minutes"), ("moiinting", "mounting"), ("othervvise", "otherwise"), ("be@ring", "bearing"), ("ﬁlter", "filter"), ("5witcb", "switch")):
        assert true in ocr_repair.candidates(seen), seen
    assert ocr_repair.candidates("cl1" * 2000) == {}


# --- markup ----------------------------------------------------------------------------------------------------------------------


def test_markup_model_on_held_out_pages():
    model, good, n = markup.markup_model(), 0, 0
    for page in markup_pages.labelled_pages(150, 4321):
        text, spans = "", []
        for raw, label in page:
            spans.append((len(text), label))
            text += raw
        blocks = markup.leaf_blocks(text)
        want = [[x for s, x in spans if s <= b.start + len(b.raw) - len(b.raw.lstrip())][-1] for b in blocks]
        good += sum(a == b for a, b in zip(model.decode(markup.featurise(blocks)), want, strict=True))
        n += len(blocks)
    assert good / n > 0.96


def elements(text):
    return set(markup.elements(text)[0])


def test_languages():
    assert elements("## Care **now** ##\n\nSee [the](/x) *end*.\n\n1. Open & close\n   2. `Shut`\n\n```sh\na  = 1\nb\n```\n\n$$\nU = R \\cdot I\n$$") == {
        ("syntax", "markdown"), ("heading", "Care now"), ("list_item", "Open & close"), ("list_item", "Shut"), ("code", "a = 1 b"), ("formula", "U = R \\cdot I"),
    }
    assert elements("<h2 class='t'>Care &ndash; now<br/></h2>\n<p>The <b>end</b>.</p>\n<UL>\n<li>One &amp; two</LI>\n<li value=3>Three\n</UL>\n<pre><code>a &lt; b</code></pre>\n<div class=\"math\">\\[E = m\\]</div>") == {
        ("syntax", "html"), ("heading", "Care – now"), ("list_item", "One & two"), ("list_item", "Three"), ("code", "a < b"), ("formula", "E = m"),
    }
    assert elements("== Care of [[Page|the]] lamp ==\n\nIt is ''old''. Use <math>x_{1}</math> here.\n\n* One\n** Two\n\n<pre>\nrun 1\n</pre>") == {
        ("syntax", "wiki"), ("heading", "Care of the lamp"), ("formula", "x_{1}"), ("list_item", "One"), ("list_item", "Two"), ("code", "run 1"),
    }
    assert elements("\\section*{Care -- \\textbf{now}}\\label{s:1}\n\nThe \\emph{end}, 5\\% more.\n\n\\begin{itemize}\n\\item One \\& two\n\\end{itemize}\n\n\\begin{verbatim}\nrun 1\n\\end{verbatim}\n\n\\begin{equation}\nE = m\n\\end{equation}") == {
        ("syntax", "latex"), ("heading", "Care – now"), ("list_item", "One & two"), ("code", "run 1"), ("formula", "E = m"),
    }


def test_plain_texts_hold_no_markup():
    for t in ("Set <MODE> to 3 and press [OK].", "The kit costs $4 to $9.", "Stay at T < 9 and P > 2 bar.", "Use screw #4.", "Ask R&D about it.", "Cut 3 * 4 * 5 mm.", "- 12 -", "", None, " \n"):
        assert elements(t) == set(), t


def test_formula_alone_is_no_language():
    assert elements("Use $x_{1} = 4$ here.") == {("formula", "x_{1} = 4")}


def test_markup_operator(spark):
    df = spark.createDataFrame([("a", "# T\n\ntext **b**"), ("a", "# T\n\ntext **b**"), ("n", None)], "chunk_id string, text string")
    assert sorted(map(tuple, markup.markup_elements(df).collect())) == [("a", "heading", "T"), ("a", "syntax", "markdown")]
    assert markup.markup_elements(df.filter("false")).count() == 0
    assert markup.plain_blocks(df).count() == 2


# --- languages -------------------------------------------------------------------------------------------------------------------

EN, DE, ZH = "The lamp is not bright and the glass of the pump was cleaned.", "Die Lampe ist nicht hell und das Glas der Pumpe wurde heute gereinigt.", "这个灯不亮，请检查水泵的玻璃。"


def language_docs(spark, more):
    rows = [(i, f"{t} {t}", lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (ZH, "zh-CN")] * 8, 100)] + more
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_relabelled(spark):
    more = [(1, EN, "de"), (2, DE, None), (3, f"{EN} {DE}\n{ZH}", "en"), (4, EN, "EN_us"), (5, DE, "German"), (6, None, "en"), (7, "12 -- ?", None), (8, "", "xx"), (9, f"{EN} „Glas“ {EN}", "eng"), (None, DE, "en"), (2, DE, None)]
    got = sorted(tuple(r) for r in langid.relabelled(language_docs(spark, more)).collect())
    assert got == [(1, 1, "en"), (2, 1, "de"), (3, 1, "en"), (3, 2, "de"), (3, 3, "zh")]


def test_segments_have_confidence_and_places(spark):
    rows = langid.language_segments(language_docs(spark, [(1, f"{EN} {DE}", "en")])).filter("doc_id = 1").orderBy("segment_no").collect()
    assert [(r["language"], r["segments"]) for r in rows] == [("en", 2), ("de", 2)] and all(0.5 < r["confidence"] <= 1 for r in rows)
    assert rows[0]["start"] == 0 and rows[1]["end"] == len(f"{EN} {DE}")


def test_labels(spark):
    from pyspark.sql import functions as F

    given = {"en-GB": "en", " urdu ": "ur", "Roman Urdu": "ur-Latn", "ur_Latn": "ur-Latn", "ur-PK": "ur", "zh-Hans": "zh", "und": None, "n/a": None, "": None, None: None, "es-MX": "es", "xx": None, "English (US)": "en", "Urdu (Roman script)": "ur-Latn", "chinese simplified": "zh", "no-label": None}
    df = spark.createDataFrame([(k,) for k in given], "l string")
    assert {r["l"]: r["v"] for r in df.select("l", langid.label_language(F.col("l")).alias("v")).collect()} == given


def test_texts_in_capitals_have_words(spark):
    assert langid.tokens("Set the LED to OFF") == ["set", "the", "to"] and langid.tokens("NIEMALS DEN DECKEL ÖFFNEN") == ["niemals", "den", "deckel", "öffnen"]
    rows = langid.language_segments(language_docs(spark, [(1, EN.upper(), "de")])).filter("doc_id = 1").collect()
    assert len(rows) == 1 and "en" in tuple(rows[0])


# --- leakage ---------------------------------------------------------------------------------------------------------------------


def test_leaks_match_planted_cases():
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("ka", "mo", "ri", "tul", "ven", "sop") for b in ("lan", "dor", "mit", "pex", "gur", "bist", "nole")]
    items = [(i, [rng.choice(vocabulary) for _ in range(60)]) for i in range(12)] + [(50, ["ka", "zz9", "mo"]), (51, [])]
    index = leakage.ItemIndex(items)
    fill = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for item, words in items[:12]:
        at = rng.randint(0, 40)
        run = words[at : at + 20]
        slips = run.copy()
        for k in (6, 13):
            slips[k] = slips[k][:2] + "x" + slips[k][2:]
        cases = {
            "exact": (run, True), "slips": (slips, True), "inserted": (run[:9] + ["see", "page", "q7"] + run[9:], True), "short": (words[at : at + 15], False),
            "values": ([w if k % 5 else "val" + str(k) for k, w in enumerate(run)], False),
        }
        for name, (part, want) in cases.items():
            text = " ".join(fill(30) + part + fill(30)).upper().replace(" ", "  ", 5)
            assert (item in {x[0] for x in leakage.leaks_of(text, index)}) is want, (item, name)
    assert {x[0] for x in leakage.leaks_of("so (Ka) ZZ9, mo.", index)} == {50}
    assert leakage.leaks_of(None, index) == leakage.leaks_of("", index) == []


def test_words_are_those_between_whitespace_without_punctuation():
    rng = random.Random(9)
    for marks in ("aB1 \t\n\x1c\x0b-'.,_$", "aBé漢٣ \u00a0\u2003\x85\u2028\u0301-’.,،\u200b½ﬁ"):
        for _ in range(2000):
            text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))
            plain = unicodedata.normalize("NFKC", text).lower()
            want = [w for w in ("".join(c for c in x if unicodedata.category(c)[0] in "LNM") for x in plain.split()) if w]
            assert leakage.words_of(text) == want, ascii(text)


def word(i):
    """A word of letters that is like no other."""
    rng = random.Random(i)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))


def test_twenty_words_with_all_that_a_case_may_have():
    """Runs of 18 to 20 words, with slips, an insertion and a divided word at many places."""
    item = [word(i) for i in range(60)]
    index = leakage.ItemIndex([(1, item)])
    other = [word(i) for i in range(100, 112)]
    for n, want in ((18, False), (19, False), (20, True)):
        for a in range(1, n - 1, 3):
            for b in range(a + 1, n - 1, 4):
                for gap in (None, 3, 9, 15):
                    for cut in (None, 7, 12):
                        words = item[20 : 20 + n]
                        words[a], words[b] = words[a][:-1] + "q" + words[a][-1], words[b][0] + words[b][2:]
                        if cut is not None and cut not in (a, b):
                            words[cut] = words[cut][:3] + " " + words[cut][3:]
                        if gap is not None:
                            words[gap:gap] = ["see", "note", "q9"]
                        got = bool(leakage.leaks_of(" ".join([*other, *words, *other]), index))
                        clear = gap is None or min(abs(gap - a), abs(gap - b), abs(gap - a - 1), abs(gap - b - 1)) > 2
                        if not want or (clear and cut is None and a > 2 and b < n - 3):  # a slip at an edge, or two side by side, may end a run
                            assert got is want, (n, a, b, gap, cut)


def test_reordered_passages_by_coverage():
    item = [word(i) for i in range(60)]
    index = leakage.ItemIndex([(1, item)])
    runs = [item[k : k + 10] for k in (30, 0, 50, 20, 40, 10)]
    doc = " ".join(" ".join([*r, "between", "them"]) for r in runs)
    assert leakage.leaks_of(doc, index) == []
    assert [(r[0], r[1], r[5]) for r in leakage.leaks_of(doc, index, 0.9)] == [(1, 60, False)]
    half = " ".join(" ".join([*r, "between", "them"]) for r in runs[:3])
    assert leakage.leaks_of(half, index, 0.9) == [] and [r[1] for r in leakage.leaks_of(half, index, 0.5)] == [30]


def test_items_that_repeat_themselves():
    rng = random.Random(2)
    for _ in range(30):
        doc, item = [[rng.choice("ab") for _ in range(n)] for n in (40, 30)]
        want = {(n, d, i) for d in range(40) for i in range(30) for n in [next((k for k in range(31) if d + k >= 40 or i + k >= 30 or doc[d + k] != item[i + k]), 31)] if n >= 3 and (d == 0 or i == 0 or doc[d - 1] != item[i - 1])}
        assert set(leakage.repeated_runs(leakage._numbers(doc), leakage._numbers(item), 3)) == want
    item = ["go", "on"] * 200
    index = leakage.ItemIndex([(1, item)])
    assert 1 in index.repeated and [r[0] for r in leakage.leaks_of("so " + "go on " * 12 + "end", index)] == [1]
    assert leakage.leaks_of("so " + "go on " * 9 + "end", index) == []


def test_what_a_mark_leaves_is_laid_later():
    """The document holds words 0-11 and, elsewhere, 8-19: the second match keeps its unmarked words 12-19."""
    item = [word(i) for i in range(24)]
    doc = [*item[:12], *[f"x{i}" for i in range(9)], *item[8:20]]
    seeds = leakage.ItemIndex([(1, item)]).matches(doc, leakage._numbers(doc), 0.5)[1]
    leaked, covered, _, _ = leakage.tiles(doc, item, seeds)
    assert (leaked, covered) == (False, 20)


def test_misspelt():
    assert leakage.misspelt("condenser", "condeser") and leakage.misspelt("the", "teh") and not leakage.misspelt("e16", "e17") and not leakage.misspelt("drain", "drive")


def test_slips_in_words_of_one_or_two_letters():
    item = [f"w{chr(97 + i)}x" for i in range(24)]
    for good, bad, want in [("at", "ats", True), ("a", "as", True), ("to", "ot", True), ("in", "it", True), ("a", "b", False), ("at", "of", False), ("e1", "e2", False)]:
        whole, words = [*item[:12], good, *item[12:]], [*item[:12], bad, *item[12:]]
        assert bool(leakage.leaks_of(" ".join(words), leakage.ItemIndex([(1, whole)]))) is want, (good, bad)
        words[13] = "other"
        assert not leakage.leaks_of(" ".join(words), leakage.ItemIndex([(1, whole)]))


def test_short_items_with_an_insertion_or_a_slip():
    for n in range(2, 20):
        item = [f"word{chr(97 + k)}" for k in range(n)]
        index = leakage.ItemIndex([(1, item)])
        for at in range(1, n):
            for slip in range(n) if n >= leakage.ONE_IN else [None]:
                words = list(item)
                if slip is not None and not at - 4 < slip < at + 3:
                    words[slip] = words[slip].replace("wo", "wwo")
                doc = ["before", *words[:at], "(see", "page)", *words[at:], "behind"]
                assert [r[0] for r in leakage.leaks_of(" ".join(doc), index)] == [1], (n, at, slip)
        assert not leakage.leaks_of(" ".join(["before", *item[:-1], "behind"]), index)


def test_leakage_operator_in_blocks(spark):
    text = " ".join(f"word{chr(97 + i)}x" for i in range(25))
    docs = spark.createDataFrame([(1, f"so {text} end"), (1, f"so {text} end"), (2, None), (3, "none of it"), (None, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (7, text), (8, None), (9, ""), (10, "other words than those")], "item_id long, text string")
    for block in (1, 100):
        assert [(r["doc_id"], r["item_id"], r["covered"]) for r in leakage.leaked_items(docs, items, block=block).collect()] == [(1, 7, 25)]
    assert leakage.leaked_pairs(docs, items.filter("false")).count() == 0 and leakage.leaked_pairs(docs.filter("false"), items).count() == 0


def test_marks_are_found_as_by_the_whole_pattern():
    """The places tried are all at which a block can begin."""
    rng = random.Random(4)
    pieces = ["a b", "\n", "  ", ": ", "$$x$$", "$", "```", "~~~", "\\[y\\]", "\\item", "\\begin{itemize}", "<li>", "<math>z</math>", "</p>", "<pre>q</pre>", "\\section{t}", "<!-- c -->", ">", "`"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        pos = 0
        while True:
            want, got = markup._SCAN.search(text, pos), markup._next_mark(text, pos)
            assert (want and (want.span(), want.group())) == (got and (got.span(), got.group())), (text, pos)
            if not want:
                break
            pos = max(want.end(), want.start() + 1)


def test_labels_decide_what_a_block_is():
    class Says:
        def __init__(self, label):
            self.label = label

        def decode(self, blocks):
            return [self.label] * len(blocks)

    text = "```\na = 1\n```"
    assert markup.elements(text, Says("markdown code"))[0] == [("syntax", "markdown"), ("code", "a = 1")]
    assert markup.elements(text, Says("formula"))[0] == [("formula", "a = 1")]
    assert markup.elements(text, Says("plain")) == ([], [(None, "text", "a = 1")])


def test_paths_are_no_commands():
    assert not markup.signs("Copy it to C:\\it\\emph now.") & {"latex"} or "latex" in markup.signs("\\emph{x}")
    assert "latex" not in markup.signs("Copy it to C:\\it now.") and "latex" in markup.signs("{\\it now}")


def test_both_token_patterns_agree_in_ascii():
    rng = random.Random(12)
    pieces = ["ab", "A", "CD", "x", "1", "22", "-", ".", "_", "'", " ", "  ", "I'M", "E-", "e1", "\n", ",", "("]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert langid._ASCII_TOKEN.findall(text) == langid._TOKEN.findall(text), text


def test_a_path_of_one_language_is_the_chain_s():
    rng = np.random.default_rng(3)
    for _ in range(300):
        emit = -rng.random((rng.integers(1, 6), 9)) * rng.choice([1, 10, 40])
        if rng.random() < 0.5:
            emit[:, 4] = 0
        path = langid.LanguageModel.path(emit)
        best = max(
            (sum(e[k] for e, k in zip(emit, ks, strict=True)) - langid.CHANGE * sum(a != b for a, b in zip(ks, ks[1:], strict=False)) for ks in itertools.product(range(9), repeat=len(emit))), default=0
        ) if len(emit) < 4 else None
        got = sum(e[k] for e, k in zip(emit, path, strict=True)) - langid.CHANGE * sum(a != b for a, b in zip(path, path[1:], strict=False))
        assert best is None or abs(got - best) < 1e-9


def test_confidence_ranks_errors():
    """Texts in which every other word is of another language are given less confidence than pure ones."""
    de = ["Die Lampe ist nicht hell und das Glas der Pumpe wurde heute gereinigt.", "Bitte schließen Sie den unteren Hahn und warten Sie auf das grüne Licht."]
    model = langid.LanguageModel.fit([(t, "en") for t in CLEAN] * 4 + [(t, "de") for t in de] * 4)
    mixed = [" ".join(w for pair in zip(a.split(), b.split(), strict=False) for w in pair) for a in CLEAN for b in de]
    sure = [c for t in [*CLEAN, *de] for _, c, _, _ in model.segments(t)]
    unsure = [c for t in mixed for _, c, _, _ in model.segments(t)]
    assert min(sure) > max(unsure)
