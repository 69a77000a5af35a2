"""Plain text and its structure out of texts with HTML, Markdown, wiki or LaTeX markup.

A text is cut into DOM leaf blocks: what stands between block tags, environments, fences and line ends. A linear-chain conditional
random field labels each block with a language and a role from ancestor-tag and text features; it is trained on labelled pages composed
in :mod:`lodestone.llm.markup_pages` and decoded by Viterbi. The labels decide how a block is cleaned.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.llm.crf import LinearChain
from lodestone.scale import spread

LANGUAGES = ("html", "markdown", "wiki", "latex")
LABELS = (
    "plain", "formula", "html text", "html heading", "html list_item", "html code", "html formula", "markdown text", "markdown heading",
    "markdown list_item", "markdown code", "wiki text", "wiki heading", "wiki list_item", "wiki code", "wiki formula", "latex text",
    "latex heading", "latex list_item", "latex code", "latex formula",
)
_HTML_TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6"
    " head header hr html i iframe img input ins kbd label li link main meta nav ol option p pre q s samp script section select small span strike"
    " strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video"
)
_WIKI_TAGS = "ref references nowiki math syntaxhighlight source gallery poem includeonly noinclude onlyinclude"
_SHARED_TAGS = "pre code"
_HTML_TAG = re.compile(rf"</?(?:{_HTML_TAGS.replace(' ', '|')})(?:\s[^<>]*|/)?\s*/?>|<!--.*?-->|<!DOCTYPE[^<>]*>", re.I | re.S)
_WIKI_TAG = re.compile(rf"</?(?:{_WIKI_TAGS.replace(' ', '|')})(?:\s[^<>]*)?/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_VERBATIM = r"verbatim\*?|lstlisting|minted|Verbatim|alltt"
_MATH_ENV = r"equation\*?|align\*?|gather\*?|displaymath|math|eqnarray\*?|multline\*?"
_LIST_ENV = r"itemize|enumerate|description"
_SECTION = r"(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?"

#: Blocks that keep their source, and block boundaries, in the order in which they are tried at a place.
_SCAN = re.compile(
    rf"""(?P<fence>^[ ]{{0,3}}(?P<f>`{{3,}}|~{{3,}})[^\n]*\n(?P<fi>.*?)(?:^[ ]{{0,3}}(?P=f)[ \t]*$|\Z))
    |(?P<pre><pre\b[^<>]*>(?P<pi>.*?)(?:</pre\s*>|\Z))
    |(?P<hl><(?P<ht>syntaxhighlight|source)\b[^<>]*>(?P<hi>.*?)</(?P=ht)\s*>)
    |(?P<comment><!--.*?-->)
    |(?P<verb>\\begin\{{(?P<ve>{_VERBATIM})\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(?P<vi>.*?)\\end\{{(?P=ve)\}})
    |(?P<eq>\\begin\{{(?P<ee>{_MATH_ENV})\}}(?P<ei>.*?)\\end\{{(?P=ee)\}})
    |(?P<display>(?:^|(?<=>))[ \t]*\$\$(?P<di>[^$]+)\$\$[ \t]*(?:$|(?=<)))
    |(?P<bracket>(?:^|(?<=>))[ \t]*\\\[(?P<bi>.+?)\\\][ \t]*(?:$|(?=<)))
    |(?P<math>^[ \t]*:*[ \t]*<math\b[^<>]*>(?P<mi>.*?)</math>[ \t]*$)
    |(?P<tag></?(?P<name>h[1-6]|li|ul|ol|p|div|table|tr|td|th|blockquote|dl|dt|dd|center|body|html|head|section|article|hr)\b[^<>]*>)
    |(?P<list>\\(?P<lk>begin|end)\{{(?P<le>{_LIST_ENV})\}}(?:\[[^\]\n]*\])?)
    |(?P<env>\\(?:begin|end)\{{[A-Za-z]+\*?\}})
    |(?P<item>\\item\b(?:\[[^\]\n]*\])?)
    |(?P<sec>\\{_SECTION}(?:\[[^\]\n]*\])?(?=\{{))
    |(?P<eol>\n)""",
    re.I | re.M | re.S | re.X,
)


_MARKS = ("eol", "fence", "pre", "hl", "comment", "verb", "eq", "display", "bracket", "math", "tag", "list", "env", "item", "sec")
_EOL = re.compile(r"(?P<fence>(?!))?" + "".join(f"(?P<{k}>(?!))?" for k in _MARKS[2:]) + r"(?P<eol>\n)")
_BLANK = re.compile(r"[ \t]*(?:\n|\Z)")
#: Every alternative of _SCAN begins with one of these, behind blanks and colons at most.
_FIRST = re.compile(r"[\n`~<\\$]")


def _next_mark(text: str, pos: int) -> re.Match | None:
    """The first match of _SCAN from ``pos`` on, tried only where one can begin."""
    at = pos
    while f := _FIRST.search(text, at):
        p = f.start()
        if text[p] == "\n":
            return _EOL.match(text, p)
        q = p
        while q > pos and text[q - 1] in " \t:":
            q -= 1
        if q < p and (m := _SCAN.match(text, q)):
            return m
        if m := _SCAN.match(text, p):
            return m
        at = p + 1
    return None


@dataclass
class Block:
    kind: str
    raw: str
    inner: str
    start: int
    ancestors: tuple[str, ...] = ()
    blank_before: bool = False
    features: list[str] = field(default_factory=list)


def _balanced(text: str, at: int) -> int:
    """The end of the group that opens at ``at``, or of the line if it never closes."""
    depth = 0
    for m in re.compile(r"\\.|[{}]|\n\s*\n", re.S).finditer(text, at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth == 0:
                return m.end()
        elif m.group()[0] == "\n":
            break
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def leaf_blocks(text: str) -> list[Block]:
    """The leaf blocks of a text in order. A block of one line, or of one element, environment or fence."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    blocks: list[Block] = []
    open_: list[str] = []
    at, kind, blank = 0, "line", True

    def leaf(kind: str, raw: str, inner: str, start: int) -> None:
        nonlocal blank
        if raw.strip():
            blocks.append(Block(kind, raw, inner, start, tuple(open_), blank))
            blank = False

    pos = 0
    while m := _next_mark(text, pos):
        what = next(k for k in _MARKS if m.group(k) is not None)
        pos = max(m.end(), m.start() + 1)
        before = text[at : m.start()]
        if what == "comment":
            continue
        if what == "eol":
            if kind in ("li", "p", "h", "item", "div") and not _BLANK.match(text, m.end()) and before.strip():
                continue  # an element goes on in the next line
            leaf(kind, before, before, at)
            if not before.strip():
                blank = True
            if kind != "line" and before.strip():
                kind = "line"
            at = m.end()
            continue
        leaf(kind, before, before, at)
        at, kind = m.end(), "line"
        if what == "tag":
            name, closing = m.group("name").lower(), m.group().startswith("</")
            if name in ("ul", "ol", "table", "tr", "td", "th", "blockquote", "dl"):
                if not closing:
                    open_.append(name)
                elif name in open_:
                    del open_[len(open_) - 1 - open_[::-1].index(name) :]
            elif not closing:
                kind = "h" if name[0] == "h" and name[1:].isdigit() else name if name in ("li", "p", "div") else "line"
            if kind == "line" or closing:
                blocks.append(Block("tag", m.group(), "", m.start(), tuple(open_), blank))
        elif what == "list":
            blocks.append(Block("env", m.group(), "", m.start(), tuple(open_), blank))
            if m.group("lk") == "begin":
                open_.append(m.group("le"))
            elif m.group("le") in open_:
                del open_[len(open_) - 1 - open_[::-1].index(m.group("le")) :]
        elif what == "env":
            blocks.append(Block("env", m.group(), "", m.start(), tuple(open_), blank))
        elif what == "item":
            kind = "item"
        elif what == "sec":
            end = _balanced(text, m.end())
            inner = text[m.end() + 1 : end - 1] if text[end - 1 : end] == "}" else text[m.end() + 1 : end]
            leaf("sec", text[m.start() : end], inner, m.start())
            at = pos = end
        else:
            inner = m.group({"fence": "fi", "pre": "pi", "hl": "hi", "verb": "vi", "eq": "ei", "display": "di", "bracket": "bi", "math": "mi"}[what])
            leaf(what, m.group(), inner, m.start())
    leaf(kind, text[at:], text[at:], at)
    return blocks


_MD_INLINE = re.compile(
    r"!\[[^\]\n]*\]\([^)\s]*\)|(?<!\[)\[[^\[\]\n]+\]\((?:[^()\s]|\([^()\s]*\))*(?:\s\"[^\"]*\")?\)|(?<![\w*\\])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?![\w*])|(?<![\w_\\])__(?=\S)[^_\n]+?(?<=\S)__(?!\w)"
    r"|(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<!`)`[^`\n]+`(?!`)|~~(?=\S)[^~\n]+~~|(?<![\w_\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w)"
)
_WIKI_INLINE = re.compile(r"'''?(?=[^\s'])|\[\[[^\[\]\n]+\]\]|(?<!\[)\[(?:https?:/|//|/)\S* [^\[\]\n]+\](?!\()|\{\{[^{}\n]*\}\}")
_LATEX_INLINE = re.compile(
    r"(?<![A-Za-z]:)\\(?:text(?:bf|it|tt|sc|sf|rm|up|md|sl)|emph|underline|label|ref|eqref|pageref|cite[pt]?|footnote|url|href|caption|includegraphics|noindent|newpage|hspace|vspace|ldots|dots|mbox|uline|textsuperscript|bf|it|tt|em|usepackage|documentclass|title|author|maketitle|item|\\)(?![A-Za-z])"
    r"|\{\\(?:bf|it|tt|em|sc|sl|rm|sf|small|large)\b|\\(?:sub)*section|\\(?:begin|end)\{|\\[%&#_](?=[\s\w]|$)"
)
_FORMULA = re.compile(r"\$\$([^$\n]+)\$\$|(?<![\w$\\])\$(?!\s)([^$\n]*?[^\s$\\])\$(?![\w$])|\\\((.+?)\\\)|\\\[(.+?)\\\]|<math\b[^<>]*>(.*?)</math>", re.S)
_MATHY = re.compile(r"[\\^_={}<>+]|^[A-Za-z](?:\s*[-*/]\s*[A-Za-z0-9])?$")
_START = re.compile(r"^[ \t]*(#{1,6}(?=[\s#*\[]|\w)|[*#:;]+(?=\s*\S)|[-+](?=\s)|\d{1,3}[.)](?=\s)|>(?=\s)|\||\{\||={1,6}(?=[^=]))")


def formulas(text: str) -> Iterator[re.Match]:
    if "$" not in text and "\\(" not in text and "\\[" not in text and "<math" not in text:
        return
    for m in _FORMULA.finditer(text):
        body = next(g for g in m.groups() if g is not None)
        if m.group()[0] != "$" or _MATHY.search(body):
            yield m


_SHARED = frozenset(_SHARED_TAGS.split())


@lru_cache(maxsize=20_000)
def signs(text: str) -> frozenset[str]:
    """The languages whose inline signs stand in a text, formulas aside. A pattern is tried only if a character that it must have is there."""
    for m in reversed(list(formulas(text))):
        text = text[: m.start()] + (" " if not m.group().startswith("<math") else "<math>") + text[m.end() :]
    out = set()
    if "<" in text:
        tags = [m.group().lower().strip("</> ").split() for m in _HTML_TAG.finditer(text)]
        if any(t[0].rstrip("/") not in _SHARED for t in tags):
            out.add("html")
        elif tags:
            out.add("shared")
        if _WIKI_TAG.search(text):
            out.add("wiki")
    if "&" in text and _ENTITY.search(text):
        out.add("entity")
    if ("''" in text or "[" in text or "{{" in text) and _WIKI_INLINE.search(text):
        out.add("wiki")
    if ("](" in text or "*" in text or "_" in text or "`" in text or "~~" in text) and _MD_INLINE.search(text):
        out.add("markdown")
    if "\\" in text and _LATEX_INLINE.search(text):
        out.add("latex")
    return frozenset(out)


_SOURCE = frozenset(("fence", "pre", "hl", "verb", "eq", "display", "bracket", "math"))
_EQUALS, _RULE, _DASHES = re.compile(r"^(={1,6})(?!=).*[^=]\1$"), re.compile(r"^(={3,}|-{3,})$"), re.compile(r"^(?:\d{1,3}\.|[-+])\s\S")
_ATX, _PIPES, _DEEP = re.compile(r"^#{1,6}\s.*#$|^#{3,6}\s"), re.compile(r"^\|.*\|$"), re.compile(r"^(?:\*\*|##)\s")
_NO_MARK = re.compile(r"\s*(?:\*[^\s*][^*]*\*|[-–—·•*]\s*[\dlIO]{1,5}\s*[-–—·•*]\s*$)")
_NUMBERS = re.compile(r"^\d+\)\s.*\d+\)\s")
_LATEX_KINDS, _HTML_KINDS = frozenset(("verb", "eq", "sec", "item", "env")), frozenset(("h", "li", "p", "div", "tag"))


def featurise(blocks: list[Block]) -> list[list[str]]:
    seen = [frozenset() if b.kind in _SOURCE else signs(b.raw) for b in blocks]
    bare = [b.raw.strip() for b in blocks]
    whole: set[str] = set()
    for b, s, raw in zip(blocks, seen, bare, strict=True):
        whole |= {"in " + x for x in s}
        if b.kind in ("hl", "math"):
            whole.add("in wiki")
        elif b.kind in _LATEX_KINDS:
            whole.add("in latex")
        elif b.kind == "fence":
            whole.add("in markdown")
        elif b.kind in _HTML_KINDS:
            whole.add("in html")
        elif b.kind == "line":
            first = raw[0]
            if first == "=" and _EQUALS.match(raw):
                whole.add("in wiki")
            if (first in "-+" or first.isdigit()) and _DASHES.match(raw):
                whole.add("in dashes")
            if first in "=-" and _RULE.match(raw):
                whole.add("in underline")
            if first == "#" and _ATX.match(raw):
                whole.add("in atx")
            if first == "|" and _PIPES.match(raw):
                whole.add("in pipes")
            if b.raw[:1] in ("*", "#") and _DEEP.match(raw):
                whole.add("in deep")
    context = "+".join(sorted(whole & {"in markdown", "in wiki", "in html", "in latex"})) or "in none"
    out = []
    for i, (b, s, raw) in enumerate(zip(blocks, seen, bare, strict=True)):
        line = b.kind == "line"
        m = _START.match(b.raw) if line else None
        mark = m.group(1) if m else ""
        if mark and _NO_MARK.match(b.raw):
            mark = ""  # emphasis or a page number
        mark = "1." if mark[:1].isdigit() and mark.endswith(".") else "1)" if mark[:1].isdigit() else mark
        feats = ["bias", "kind " + b.kind, "mark " + mark, f"kind {b.kind} up {b.ancestors[-1] if b.ancestors else 'root'}", f"mark {mark} {context}"]
        for x in s:
            feats += [f"sign {x}", f"kind {b.kind} sign {x}"]
        for x in whole:
            feats += [f"doc {x}", f"kind {b.kind} doc {x}", f"mark {mark} doc {x}"]
        if line:
            after = bare[i + 1] if i + 1 < len(blocks) else ""
            if raw[0] == "=" and _EQUALS.match(raw):
                feats += ["equals", "equals " + context]
            if raw[0] in "=-" and not b.blank_before and _RULE.match(raw):
                feats.append("underline")
            if after[:1] in ("=", "-") and not mark and len(raw) < 120 and not blocks[i + 1].blank_before and _RULE.match(after):
                feats.append("underlined")
            if raw[0] == "|" and _PIPES.match(raw):
                feats += ["row", "row near" if (i and bare[i - 1][:1] == "|") or after[:1] == "|" else "row alone"]
            if raw[0] == "%":
                feats.append("percent " + ("latex" if "in latex" in whole else "none"))
            if mark:
                feats += ["mark space" if b.raw[m.end() :][:1].isspace() else "mark tight", f"mark {mark} indent" if b.raw[:1].isspace() else f"mark {mark} flush"]
                if raw[0].isdigit() and _NUMBERS.match(raw):
                    feats.append("run of numbers")
            if raw[0] == "#" and raw[-1] == "#":
                feats.append("closed hash")
            feats.append("short" if len(raw) < 60 else "long")
        out.append(feats)
    return out


@lru_cache(maxsize=1)
def markup_model(pages: int = 700, seed: int = 7) -> LinearChain:
    from lodestone.llm.markup_pages import labelled_pages

    sequences = []
    for page in labelled_pages(pages, seed):
        text, spans = "", []
        for raw, label in page:
            spans.append((len(text), label))
            text += raw
        blocks = leaf_blocks(text)
        labels = [[label for start, label in spans if start <= b.start + len(b.raw) - len(b.raw.lstrip())][-1] for b in blocks]
        sequences.append(list(zip(featurise(blocks), labels, strict=True)))
    return LinearChain.fit(LABELS, sequences)


def _latex_text(s: str) -> str:
    s = re.sub(r"(?<!\\)%.*", "", s)
    for _ in range(6):
        new = re.sub(r"~?\\(?:label|ref|eqref|pageref|cite[pt]?|footnote|index|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
        new = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", new)
        new = re.sub(r"\\(?!begin|end)[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", new)
        new = re.sub(r"\{\\(?:bf|it|tt|em|sc|sl|rm|sf|small|large)(?![A-Za-z])\s*([^{}]*)\}", r"\1", new)
        if new == s:
            break
        s = new
    s = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", " ", s)
    s = re.sub(r"\\(?:ldots|dots)(?![A-Za-z])", "…", s)
    s = re.sub(r"\\textbackslash(?![A-Za-z])", lambda _: "\\", s)
    s = re.sub(r"\\(?:noindent|newpage|item|bf|it|tt|em|par|quad|qquad|centering|small|large)(?![A-Za-z])\s?", "", s)
    s = re.sub(r"\\\\", " ", s)
    s = re.sub(r"(?<!\\)~", " ", s)
    s = s.replace("``", "“").replace("''", "”")
    return re.sub(r"\\([%&#_${} ~^])", r"\1", s)


def _markdown_text(s: str) -> str:
    s = re.sub(r"!\[([^\]\n]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", s)
    s = re.sub(r"\[([^\[\]\n]+)\]\((?:[^()]|\([^()]*\))*\)|\[([^\[\]\n]+)\]\[[^\]]*\]", lambda m: m.group(1) or m.group(2), s)
    s = re.sub(r"<((?:https?|mailto):[^<>\s]+)>", r"\1", s)
    for mark in (r"\*\*\*", r"\*\*", "__", r"\*", "~~", "_", "`"):
        s = re.sub(rf"(?<![\\\w]){mark}(?=\S)((?:[^\n])+?)(?<=\S){mark}(?![\w])", r"\1", s) if mark in ("_", "__") else re.sub(rf"(?<!\\){mark}(?=\S)([^\n]+?)(?<=[^\s\\]){mark}", r"\1", s)
    s = _HTML_TAG.sub(" ", s) if _HTML_TAG.search(s) else s
    return re.sub(r"\\([\\`*_{}\[\]()#+\-.!|~<>$%&])", r"\1", html.unescape(s))


def _wiki_text(s: str) -> str:
    s = re.sub(r"<ref\b[^<>/]*>.*?</ref>|<ref\b[^<>]*/>", "", s, flags=re.I | re.S)
    for _ in range(4):
        s = re.sub(r"\{\{([^{}]*)\}\}", lambda m: m.group(1).split("|")[-1] if "|" in m.group(1) else "", s)
    s = re.sub(r"\[\[([^\[\]]*)\]\]", lambda m: m.group(1).split("|")[-1], s)
    s = re.sub(r"(?<!\[)\[(?:https?:/|//|/|mailto:)\S* ([^\[\]]+)\]", r"\1", s)
    s = re.sub(r"'{2,5}", "", s)
    s = _WIKI_TAG.sub("", s)
    return html.unescape(_HTML_TAG.sub("", s))


def _html_text(s: str) -> str:
    s = re.sub(r"<(script|style)\b.*?</\1\s*>", " ", s, flags=re.I | re.S)
    s = re.sub(r"<(?:br|hr|/?p|/?div|/?li|/?t[dhr])\b[^<>]*>", " ", s, flags=re.I)
    return html.unescape(_HTML_TAG.sub("", s))


_CLEAN = {"latex": _latex_text, "markdown": _markdown_text, "wiki": _wiki_text, "html": _html_text}


def squeeze(s: str) -> str:
    return " ".join(s.replace("\u200b", "").replace("\ufeff", "").split())


def clean_inline(text: str, language: str | None) -> str:
    """A stretch without its markup; formulas keep their source between the delimiters."""
    kept: list[str] = []

    def keep(body: str) -> str:
        kept.append(body.strip())
        return f"\ue000{len(kept) - 1}\ue001"

    for m in reversed(list(formulas(text))):
        text = text[: m.start()] + keep(next(g for g in m.groups() if g is not None)) + text[m.end() :]
    if language:
        text = _CLEAN[language](text)
        text = re.sub(r"(?<![-\w])---?(?![-\w])|(?<=\w)---?(?=\w)|—", "–", text)
    return squeeze(re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], text))


def elements(text: str | None, model: LinearChain | None = None) -> tuple[list[tuple[str, str]], list[tuple[str | None, str, str]]]:
    """``(element, content)`` rows in order, and ``(language, role, plain text)`` of each block. A null or blank text has none."""
    if not text or not text.strip():
        return [], []
    blocks = leaf_blocks(text)
    labels = (model or markup_model()).decode(featurise(blocks))
    rows: list[tuple[str, str]] = []
    plain: list[tuple[str | None, str, str]] = []
    languages: dict[str, None] = {}
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        language, _, role = label.rpartition(" ")
        if label in ("plain", "formula"):
            language, role = "", label if label == "formula" else "text"
        if language:
            languages[language] = None
        if role == "code" and b.kind in _SOURCE:
            inner = re.sub(r"^\s*<code\b[^<>]*>|</code\s*>\s*$", "", b.inner, flags=re.I) if b.kind == "pre" else b.inner
            content = squeeze(html.unescape(_HTML_TAG.sub("", inner)) if b.kind == "pre" else inner)
            rows.append(("code", content))
        elif role == "formula" and b.kind in _SOURCE:
            content = squeeze(re.sub(r"\\label\{[^{}]*\}", "", html.unescape(b.inner)))
            rows.append(("formula", content))
        elif role in ("heading", "list_item"):
            body = b.inner
            if b.kind == "line":
                if language == "wiki" and role == "heading":
                    body = re.sub(r"^\s*=+|=+\s*$", "", body)
                elif role == "heading":
                    body = re.sub(r"^\s*#{1,6}\s*|\s+#+\s*$", "", body)
                else:
                    body = re.sub(r"^\s*(?:[*#:;]+|[-+]|\d{1,3}[.)])\s*", "", body)
            content = clean_inline(body, language or None)
            if content:
                rows.append((role, content))
            rows += [("formula", squeeze(html.unescape(next(g for g in m.groups() if g is not None)))) for m in formulas(body)]
        else:
            if re.fullmatch(r"\s*(?:={3,}|-{3,})\s*", b.raw) and language:
                continue
            content = clean_inline(b.inner, language or None) if b.kind not in ("tag", "env") else ""
            rows += [("formula", squeeze(html.unescape(next(g for g in m.groups() if g is not None)))) for m in formulas(b.inner)]
        if content:
            plain.append((language or None, role, content))
    return [("syntax", x) for x in LANGUAGES if x in languages] + [r for r in rows if r[1]], plain


def _with_model(chunks: DataFrame):  # noqa: ANN202
    return chunks.sparkSession.sparkContext.broadcast(markup_model())


def markup_elements(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, element, content)``, each distinct row once. The model is of fixed size, trained once on the driver and broadcast."""
    model = _with_model(chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, e, c) for i, t in zip(pdf["chunk_id"], pdf["text"], strict=True) for e, c in dict.fromkeys(elements(t, model.value)[0])]
            yield pd.DataFrame(rows, columns=["chunk_id", "element", "content"])

    return spread(chunks.select("chunk_id", "text")).mapInPandas(run, "chunk_id string, element string, content string").distinct()


def plain_blocks(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, block_no, language, role, content)``: the clean text of each chunk in order, with its structure."""
    model = _with_model(chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, *b) for i, t in zip(pdf["chunk_id"], pdf["text"], strict=True) for n, b in enumerate(elements(t, model.value)[1], 1)]
            yield pd.DataFrame(rows, columns=["chunk_id", "block_no", "language", "role", "content"])

    schema = "chunk_id string, block_no int, language string, role string, content string"
    return spread(chunks.select("chunk_id", "text")).mapInPandas(run, schema).distinct()
