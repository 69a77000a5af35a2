"""A loop that answers questions one by one; the answering is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterable

QUIT = ("quit", "exit", "q")


def loop(lines: Iterable[str], answer: Callable[[str], tuple[str, list[str]]], say: Callable[[str], None] = print) -> int:
    """Answer each line that is not blank until one asks to stop; ``answer`` gives a text and its sources. The number of answers is returned."""
    n = 0
    for line in lines:
        question = line.strip()
        if question.lower() in QUIT:
            break
        if not question:
            continue
        text, sources = answer(question)
        say(text)
        for source in sources:
            say(f"  - {source}")
        n += 1
    return n
