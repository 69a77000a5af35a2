"""Labelled pages in HTML, Markdown, wiki, LaTeX and plain text, composed for training the block model."""

from __future__ import annotations

import random

from lodestone.llm.line_model import _PROSE, _THINGS, _TOPICS

_STEPS = ("Open the side cover", "Loosen both bolts & the ring", "Wait 12 seconds", "Fill the tank to 40%", "Write down code F3", "Close the tap", "Pump: 2.4 A at 3 bar")
_CODE = ("set level=4\nwait 12", "x = 3\ny = x + 4", "START -q 2 && SHOW 4", "if a < 3:\n    stop(a)", "# reload\nGET /unit/4?x=1", "* not a list\n== 4")
_MATH = (r"U = R \cdot I", r"\frac{a}{b} = c^{2}", "E = m c^{2}", r"x_{1} + x_{2} = 4", r"P \approx 3 \pi r")
_DECOYS = (
    "Set <LEVEL> to 3 and press [GO].", "The set costs $4 to $9.", "Keep x < 4 and y > 2.", "Press { and } together.", "1) open 2) wait 3) close", "Take bolt #4 for it.",
    "Cut it to 3 * 4 * 5 cm.", "See [4] for the plan.", "Test if A == B holds.", "The rod -- about 4 cm -- slides.", "Ask Q&A about it.", "Copy run_log_2.txt to C:\\tmp\\log.",
    "About ~4 cm, 5% more.", "NOTE", "Weight (kg)", "44", "- 44 -", "— 12 —", "*see* below", "[12]",
)


def _inline(rng: random.Random, s: str, forms: tuple[str, ...], p: float) -> str:
    words = s.split(" ")
    for i, w in enumerate(words):
        if w.isalpha() and rng.random() < p:
            words[i] = rng.choice(forms).replace("{}", w)
    return " ".join(words)


_FORMS = {
    "markdown": ("**{}**", "*{}*", "__{}__", "`{}`", "[{}](/a/b)", "![{}](x.png)"),
    "wiki": ("'''{}'''", "''{}''", "[[{}]]", "[[Some page|{}]]", "[/a/b {}]", "{{mark|{}}}", "{}<ref>p. 2</ref>"),
    "html": ("<b>{}</b>", "<I>{}</I>", '<a href="/x.htm">{}</a>', "<span style='x'>{}</span>", "<strong>{}</strong>", "<u>{}</u>", "{}<br/>", "{}&nbsp;", "&lt;{}&gt;", "<font size=3>{}</font>"),
    "latex": (r"\textbf{{}}", r"\emph{{}}", r"\texttt{{}}", r"\underline{{}}", r"{\bf {}}", r"{}~\ref{t:1}", r"{}\footnote{see b}"),
    "plain": ("{}",),
}


def _prose(rng: random.Random, lang: str, p: float) -> str:
    return _inline(rng, " ".join(rng.choice(_PROSE) for _ in range(rng.randint(1, 3))), _FORMS[lang], p)


def _title(rng: random.Random) -> str:
    return f"{rng.choice(_TOPICS)} of the {rng.choice(_THINGS).lower()}" + (f" {rng.randint(1, 60)}" if rng.random() < 0.3 else "")


def _page(rng: random.Random, lang: str) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    dense = rng.choice((0.0, 0.04, 0.08, 0.2)) if lang != "plain" else 0.0
    if lang == "latex" and rng.random() < 0.2:
        out.append(("% from a sheet\n", "latex text"))
    parts = rng.choices(("h", "t", "t", "l", "c", "m", "d", "table"), k=rng.randint(1, 9))
    if lang == "plain":
        parts = rng.choices(("t", "t", "d", "m", "wrap"), (4, 4, 3, 0.5, 1), k=rng.randint(1, 5))
    ordered, style = rng.random() < 0.5, rng.randrange(3)
    for part in parts:
        gap = "\n" if lang == "html" and rng.random() < 0.7 else "\n\n"
        if part == "t":
            p = _prose(rng, lang, dense)
            label = "plain" if lang == "plain" or not _marked(p, lang) else f"{lang} text"
            if rng.random() < 0.15 and lang in ("markdown", "latex"):
                p += f" Use ${rng.choice(_MATH)}$ here."
            if lang == "wiki" and rng.random() < 0.15:
                p, label = p + f" Use <math>{rng.choice(_MATH)}</math> here.", "wiki text"
            if lang == "html" and rng.random() < 0.7:
                p, label = f"<p>{p}" + ("</p>" if rng.random() < 0.8 else ""), "html text"
            out.append((p + gap, label))
        elif part == "h":
            t, n = _inline(rng, _title(rng), _FORMS[lang], dense), rng.randint(1, 4)
            if lang == "markdown":
                if style == 0:
                    out += [(t + "\n", "markdown heading"), ("=-"[rng.random() < 0.5] * rng.randint(4, 20) + gap, "markdown text")]
                else:
                    out.append(("#" * n + " " + t + (" " + "#" * n if rng.random() < 0.3 else "") + gap, "markdown heading"))
            elif lang == "wiki":
                s = rng.choice(("", " "))
                out.append(("=" * (n + 1) + s + t + s + "=" * (n + 1) + gap, "wiki heading"))
            elif lang == "html":
                out.append((f"<h{n}{rng.choice(('', ' id=x'))}>{t}</h{n}>" + gap, "html heading"))
            elif lang == "latex":
                out.append((f"\\{rng.choice(('section', 'section*', 'subsection', 'subsubsection', 'paragraph'))}{{{t}}}", "latex heading"))
                out.append((rng.choice(("", "\\label{s:1}")) + gap, "latex text"))
        elif part == "l":
            items = [_inline(rng, rng.choice(_STEPS), _FORMS[lang], dense) for _ in range(rng.randint(1, 5))]
            if lang == "html":
                items = [x.replace("&", "&amp;") if "&nbsp" not in x and "&lt" not in x else x for x in items]
                out.append((f"<{'ol' if ordered else 'ul'}>\n", "html text"))
                for x in items:
                    out.append((f"<li{rng.choice(('', ' value=2'))}>{x}" + rng.choice(("</li>", "</LI>", "")), "html list_item"))
                    out.append(("\n", "html text"))
                out.append((f"</{'ol' if ordered else 'ul'}>" + gap, "html text"))
            elif lang == "latex":
                env = rng.choice(("itemize", "enumerate"))
                out.append((f"\\begin{{{env}}}\n", "latex text"))
                out += [(f"\\item {x}".replace(" &", " \\&").replace("%", "\\%") + "\n", "latex list_item") for x in items]
                out.append((f"\\end{{{env}}}" + gap, "latex text"))
            else:
                bullet = rng.choice("*-+")
                for k, x in enumerate(items, 1):
                    if lang == "wiki":
                        mark = ("#" if ordered else "*") * (2 if k > 1 and rng.random() < 0.3 else 1) + " "
                    else:
                        mark = "   " * (k > 1 and rng.random() < 0.3) + (f"{k}. " if ordered else bullet + " ")
                    out.append((mark + x + "\n", f"{lang} list_item"))
                out.append(("\n", f"{lang} list_item"))
        elif part == "c":
            c = rng.choice(_CODE)
            if lang == "markdown":
                f = rng.choice(("```", "~~~", "```sh"))
                out.append((f"{f}\n{c}\n{f[:3]}" + gap, "markdown code"))
            elif lang == "wiki":
                out.append((rng.choice((f'<syntaxhighlight lang="text">\n{c}\n</syntaxhighlight>', f"<pre>\n{c}\n</pre>")) + gap, "wiki code"))
            elif lang == "html":
                c = c.replace("&", "&amp;").replace("<", "&lt;")
                out.append((rng.choice((f"<pre>{c}</pre>", f"<pre><code>{c}</code></pre>")) + gap, "html code"))
            elif lang == "latex":
                env = rng.choice(("verbatim", "lstlisting"))
                out.append((f"\\begin{{{env}}}\n{c}\n\\end{{{env}}}" + gap, "latex code"))
        elif part == "m":
            x = rng.choice(_MATH)
            if lang == "wiki":
                out.append((rng.choice((f":<math>{x}</math>", f'<math display="block">{x}</math>')) + gap, "wiki formula"))
            elif lang == "latex" and rng.random() < 0.6:
                out.append((f"\\begin{{equation}}\n{x}\n\\end{{equation}}" + gap, "latex formula"))
            elif lang == "html" and rng.random() < 0.7:
                out += [('<div class="math">', "html text"), (f"\\[{x}\\]", "formula"), ("</div>" + gap, "html text")]
            else:
                out.append((rng.choice((f"$$\n{x}\n$$", f"$${x}$$", f"\\[ {x} \\]")) + gap, "formula"))
        elif part == "d":
            out.append((rng.choice(_DECOYS) + gap, "plain"))
        elif part == "wrap":
            words = _prose(rng, "plain", 0).split()
            out += [(" ".join(words[i : i + 9]) + "\n", "plain") for i in range(0, len(words), 9)] + [("\n", "plain")]
        elif part == "table" and lang == "markdown":
            out += [("| Code | Part |\n", "markdown text"), ("|---|:--|\n", "markdown text")]
            out += [(f"| {rng.choice(('F1', '**F2**'))} | {rng.choice(_THINGS)} |\n", "markdown text") for _ in range(rng.randint(1, 3))]
            out.append(("\n", "markdown text"))
    if lang in ("markdown", "wiki", "latex") and rng.random() < 0.1 and out:
        p = _prose(rng, "plain", 0)
        out.append((rng.choice((f"<p>{p}", f"<div>{p}</div>", f"<font color=red>{p}</font>", f"{p}<br><br>")) + "\n", "html text"))
    return out or [("x\n", "plain")]


def _marked(p: str, lang: str) -> bool:
    from lodestone.llm.markup import signs

    found = signs(p)
    return lang in found or (lang == "html" and "entity" in found)


def labelled_pages(count: int, seed: int) -> list[list[tuple[str, str]]]:
    rng = random.Random(seed)
    return [_page(rng, rng.choice(("markdown", "wiki", "html", "latex", "plain"))) for _ in range(count)]
