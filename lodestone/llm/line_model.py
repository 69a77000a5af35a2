"""Hidden Markov model over the lines of a page: running header, page number, body, loose note or break, on a scanned or on another page.

Each line is seen as a tuple of discrete layout features; a state emits the features independently. A state tells the line's part and the
page's kind, which no transition changes, so the best path decides both at once. Start, transition and emission probabilities are counts over
labelled pages, smoothed by one. The labelled pages are composed here (:func:`labelled_pages`): prose is wrapped to a random width, and
furniture, loose notes and blank lines are put in with their labels.
"""

from __future__ import annotations

import math
import random
import re
import textwrap
from collections import Counter, defaultdict
from functools import lru_cache

STATES = ("body", "header", "pagenum", "note", "break")
#: Kinds of pages: cut into lines by the paper's width, or not.
KINDS = ("scanned", "other")
FEATURES = 11

#: Marks that recognition takes for digits, besides the digits.
_N = r"(?=[0-9lIOoSsBZz!|]{1,5}\b|[0-9lIOoSsBZz!|]{1,5}(?:\s|$))[0-9lIOoSsBZz!|]{1,5}"
_MARKED = re.compile(
    rf"^(?:[-–—·•~*=_|]+\s*{_N}\s*[-–—·•~*=_|]+|[\[(<{{]\s*{_N}\s*[\])>}}]|p(?:g|p|age)?\.\s*{_N}"
    rf"|[Pp][Aa@][GgQq9][EeCc]\s+{_N}(?:\s+[oO0][fF]\s+{_N})?|{_N}\s*/\s*{_N}|{_N}\s+[oO0][fF]\s+{_N})$"
)
_BARE = re.compile(r"^(?=.*\d)[0-9lIOoSB!]{1,4}$|^[lIO]{2,3}$")
_WORD = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"^(?:[#>|`~+*-]|=+|\d+[.)]\s|\\\w|</?\w|[{}:;])|[`|>]$|=+$|[{}\\]|\*\*|\]\(|''|\[\[")


def page_number_form(line: str) -> bool:
    """A page number by its form alone, whether or not its digits are misread."""
    s = line.strip()
    return bool(_MARKED.match(s)) and (any(c.isdigit() for c in s) or bool(re.search(r"[lIO!|]", s)))


def number_form(line: str) -> bool:
    return page_number_form(line) or bool(_BARE.match(line.strip()))


def markup_form(line: str) -> bool:
    s = line.strip()
    return s[:1] == "|" or bool(_MARKUP.search(s) and not re.search(r"\w \| \w", s))


_DIGITS = re.compile(r"\d+|(?<!\w)[lIO!]+(?!\w)")
_LAST_NUMBER, _GAP, _BAR = re.compile(r"\s[lIO\d]{1,4}$"), re.compile(r"\S\s{2,}\S"), re.compile(r"\s[|–—·•]\s")


def _skeleton(line: str) -> str:
    return " ".join(_DIGITS.sub("", line).split()).lower()


def _shape(s: str) -> tuple:
    """What a line alone tells: shape, case, end, inner form, words, and whether it has the form of a page number."""
    words = _WORD.findall(s)
    caps = sum(w[0].isupper() for w in words)
    # a page number has at most a few words or marks; longer lines need not be tried
    marked = len(s) <= 60 and page_number_form(s)
    bare = len(s) <= 8 and bool(_BARE.match(s))
    shape = "marked" if marked else "number" if bare else "markup" if markup_form(s) else "words" if words else "other"
    case = "none" if not words else "upper" if s.upper() == s else "title" if caps >= 0.6 * len(words) else "start" if s[0].isupper() else "low"
    last = s[-1]
    ends = "stop" if last in ".!?:;,۔؟" else "hyphen" if last in "-‐‑\xad¬" else "paren" if last == ")" else "digit" if last.isdigit() or (last in "lIO" and _LAST_NUMBER.search(s)) else "open"
    inner = "gap" if _GAP.search(s) else "bar" if len(words) <= 8 and _BAR.search(s) else "plain"
    return shape, case, ends, inner, bool(words), marked, bare


def features(lines: list[str]) -> list[tuple]:
    """A tuple of discrete features for each line."""
    bare = [x.strip() for x in lines]
    lengths = sorted(len(x) for x in bare if x)
    width = max(1, lengths[int(0.9 * (len(lengths) - 1))]) if lengths else 1
    full = [i for i, x in enumerate(bare) if x]
    forms = [_shape(bare[i]) for i in full]
    skeletons = [_skeleton(bare[i]) for i in full]
    seen = Counter(skeletons)
    out: list[tuple] = [BLANK] * len(bare)
    before = ""
    for k, i in enumerate(full):
        s, (shape, case, ends, inner, words, _, _) = bare[i], forms[k]
        ratio = len(s) / width
        size = "full" if ratio > 0.82 else "long" if ratio > 0.6 else "mid" if ratio > 0.35 else "short"
        open_before = bool(before) and before[-1] not in ".!?:۔؟" and len(before) > 0.6 * width
        flow = "first" if not before else ("open" if open_before else "shut") + ("-low" if s[0].islower() else "-up")
        around = [forms[j] for j in (k - 1, k + 1) if 0 <= j < len(full)]
        near = "page" if any(f[5] for f in around) else "number" if any(f[6] for f in around) else "none"
        often = "many" if words and seen[skeletons[k]] > 1 else "once"
        unit = "unit" if before.endswith(")") and len(before) < 30 else "none"
        trail = "space" if lines[i][-1] == " " else "none"
        out[i] = (shape, case, ends, size, inner, flow, near, often, unit, "narrow" if width < 90 else "middle" if width < 130 else "wide", trail)
        before = s
    return out


BLANK = ("blank",) + ("",) * (FEATURES - 1)


_PROSE = (
    "Keep the lamp away from open windows and clean the glass with a dry cloth after each use.",
    "When the pump has run for 12 minutes, close the lower tap and wait until the pressure falls below 3.2 bar.",
    "The left handle turns the inner ring, whereas the right one only locks it; never force either of them.",
    "Our store in the harbour keeps the usual spare parts, but long hoses must be ordered a week before.",
    "Did the needle stay at zero? Then open the side panel and look for a loose wire behind the meter.",
    "A faint smell of oil is normal in the first hours and goes away once the seals have settled.",
    "In most houses the supply is strong enough, yet old cables – especially in cellars – should be tested.",
    "For the model QX-310, use only the short belt, since the longer one slips under load.",
    "Replace the filter twice a year and write the date, code F7 and your name on the card inside the door.",
    "The engineer found that two of the five bolts were missing, which explains the heavy rattling.",
    "As soon as the green light is on, press the upper key for 5 seconds and let go slowly.",
    "Children must not open the rear cover, even when the plug has been pulled out of the wall.",
)
_THINGS = ("Pump", "Lamp", "Garden Heater", "Water Boiler", "Sewing Machine", "Belt Drive", "Fan", "Grinder", "Floor Polisher")
_MAKERS = ("Norlan", "Vestra", "Quillon", "Hartex", "Ombra")
_TOPICS = ("Safety", "Mounting", "First Use", "Care", "Faults", "Spare Parts", "Technical Data")


def _header(rng: random.Random, page: int) -> str:
    maker, thing, topic = rng.choice(_MAKERS), rng.choice(_THINGS), rng.choice(_TOPICS)
    form = rng.choice(
        (
            f"{maker} {thing}  Rev. {rng.randint(1, 9)}", f"{maker} {thing.lower()}  Rev. {rng.randint(1, 9)}", f"{thing} – {topic}",
            f"CHAPTER {rng.randint(1, 14)}  {topic.upper()}", f"Chapter {rng.randint(1, 14)}: {topic}", f"{maker.upper()} OWNER MANUAL",
            f"Owner Handbook | {topic}", f"{maker} {thing} Handbook", f"{topic} · {thing}", f"Section {rng.randint(1, 9)} – {topic}",
            f"{maker.upper()} {thing.upper()}  ED. {rng.randint(1, 9)}",
        )
    )
    if rng.random() < 0.1:
        form = form.replace(rng.choice("SIOelo"), rng.choice("5l1c0"), 1)
    return form


def _number(rng: random.Random, style: int, page: int) -> str:
    n = str(page).replace("1", rng.choice("l1111111"))
    return (f"- {n} -", f"Page {n}", f"p. {n}", f"[{n}]", f"· {n} ·", f"{n} / 240", f"Page {n} of 240", n, n, n, f"— {n} —", f"PAGE {n}")[style]


def labelled_pages(count: int, seed: int = 11) -> list[tuple[str, list[tuple[str, str]]]]:
    """``count`` texts as (kind, list of (line, state)). A quarter has no furniture; some are not wrapped at all.

    Lines that end in a space, and blocks of markup, are of another origin than a scanner.
    """
    rng = random.Random(seed)
    texts = []
    for _ in range(count):
        wrapped, furniture = rng.random() < 0.85, rng.random() < 0.75
        width, style, page = rng.randint(48, 82) if rng.random() < 0.8 else rng.randint(83, 200), rng.randrange(12), rng.randint(2, 230)
        trail = " " if rng.random() < 0.12 else ""
        if trail or not wrapped:
            furniture = False
        header = _header(rng, page) if rng.random() < 0.8 else None
        with_number = rng.random() < 0.8 or header is None
        number_in = rng.random() < 0.3
        out: list[tuple[str, str]] = []

        def furnish() -> None:
            nonlocal page
            parts = []
            if with_number:
                parts.append((" " * rng.choice((0, 0, 0, 3)) + _number(rng, style, page), "pagenum"))
            page += 1
            if header:
                h = header + (f"   {page}" if number_in else "")
                parts.append((h.replace("E", "3", 1) if rng.random() < 0.05 else h, "header"))
            if rng.random() < 0.3:
                parts = parts[::-1]
            for p in parts:
                out.extend([("", "break")] * rng.choice((0, 0, 1, 1, 2)))
                out.append(p)
            out.extend([("", "break")] * rng.choice((0, 0, 1, 1, 2)))

        if furniture and rng.random() < 0.5:
            furnish()
        for number in range(rng.randint(1, 4)):
            if number:
                out.append(("", "break"))
            prose = " ".join(rng.choice(_PROSE) for _ in range(rng.randint(2, 4) + (width > 82 and 3)))
            lines = textwrap.wrap(prose, width) if wrapped else [prose] if rng.random() < 0.7 else [rng.choice(_PROSE) for _ in range(rng.randint(1, 3))]
            if wrapped and furniture:
                for i in range(len(lines) - 1):
                    if rng.random() < 0.12 and lines[i + 1][:3].isalpha():
                        lines[i], lines[i + 1] = lines[i] + " " + lines[i + 1][:2] + "-", lines[i + 1][2:]
            for i, line in enumerate(lines):
                stray = " " if rng.random() < (0.4 if line[-1] == "-" else 0.03) else ""
                out.append((line + (trail or stray), "body"))
                if furniture and i < len(lines) - 1 and rng.random() < 0.1:
                    furnish()
            if rng.random() < 0.12:
                out.append(("", "break"))
                out += [(x, "note") for x in rng.choice((("Weight (kg)", str(rng.randint(2, 99)), "Voltage (V)", "230"), ("NOTE", f"See plate no. {rng.randint(1, 99)}"), ("Use fuse #4 here.",), ("WARNING",)))]
            if not wrapped and rng.random() < 0.3:
                out += [("", "break"), (rng.choice(("## " + rng.choice(_TOPICS), "== " + rng.choice(_TOPICS) + " ==", "1. Open the cover", "| A | B |", "<ul>", "\\begin{itemize}", "```")), "note")]
        if furniture and rng.random() < 0.5:
            furnish()
        cut = any(a == "body" and b == "body" and x[-1] not in ".!?" for (x, a), (_, b) in zip(out, out[1:], strict=False))
        texts.append(("scanned" if wrapped and not trail and cut else "other", out))
    return texts


class LineModel:
    """States are numbered by kind, then by part; moves between kinds do not exist."""

    def __init__(self, start: list[float], move: list[list[list[float]]], emit: list[dict[str, list[float]]], floor: list[list[float]]) -> None:
        self.start, self.move, self.emit, self.floor = start, move, emit, floor
        self._seen: dict[tuple, list[float]] = {}

    @classmethod
    def fit(cls, pages: list[tuple[str, list[tuple[str, str]]]]) -> LineModel:
        n = len(STATES)
        start, move, total = Counter(), Counter(), Counter()
        emit: list[Counter] = [Counter() for _ in range(FEATURES)]
        values: list[set] = [set() for _ in range(FEATURES)]
        for kind, page in pages:
            states = [n * KINDS.index(kind) + STATES.index(s) for _, s in page]
            start[states[0]] += 1
            move.update(zip(states, states[1:], strict=False))
            for state, f in zip(states, features([line for line, _ in page]), strict=True):
                total[state] += 1
                for k, v in enumerate(f):
                    emit[k][state, v] += 1
                    values[k].add(v)
        every = range(n * len(KINDS))
        out = Counter()
        for (a, _), m in move.items():
            out[a] += m
        return cls(
            [math.log((start[s] + 1) / (len(pages) + len(every))) for s in every],
            [[[math.log((move[a, b] + 1) / (out[a] + n)) for a in range(k, k + n)] for b in range(k, k + n)] for k in range(0, len(every), n)],
            [{v: [math.log((emit[k][s, v] + 0.5) / (total[s] + 0.5 * len(values[k]) + 0.5)) for s in every] for v in values[k]} for k in range(FEATURES)],
            [[math.log(0.5 / (total[s] + 0.5 * len(values[k]) + 0.5)) for s in every] for k in range(FEATURES)],
        )

    def _emission(self, f: tuple) -> list[float]:
        got = self._seen.get(f)
        if got is None:
            if len(self._seen) >= 100_000:
                self._seen.clear()
            got = self._seen[f] = [sum(x) for x in zip(*[self.emit[k].get(v, self.floor[k]) for k, v in enumerate(f)], strict=True)]
        return got

    def decode(self, lines: list[str]) -> tuple[str, list[str]]:
        """The most probable kind of a page and states of its lines (Viterbi)."""
        if not lines:
            return "other", []
        n = len(STATES)
        emits = [self._emission(f) for f in features(lines)]
        best: tuple[float, int, list[int]] | None = None
        for kind, moves in enumerate(self.move):
            low = n * kind
            score = [self.start[low + s] + emits[0][low + s] for s in range(n)]
            back = []
            for e in emits[1:]:
                new, came = [], []
                for s in range(n):
                    ways = [x + m for x, m in zip(score, moves[s], strict=True)]
                    top = max(ways)
                    came.append(ways.index(top))
                    new.append(top + e[low + s])
                score = new
                back.append(came)
            top = max(score)
            if best is None or top > best[0]:
                path = [score.index(top)]
                for came in reversed(back):
                    path.append(came[path[-1]])
                best = top, kind, path[::-1]
        return KINDS[best[1]], [STATES[s] for s in best[2]]


@lru_cache(maxsize=1)
def line_model(pages: int = 1500, seed: int = 11) -> LineModel:
    return LineModel.fit(labelled_pages(pages, seed))
