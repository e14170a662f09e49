"""Captions over a page's labels, asked for out of order where that changes nothing.

A page's captions are folded into its text in the order of its labels, and each is asked for
with the first characters of the text so far.  So a caption depends on an earlier one only if
that one's label stands near the text's beginning, or if it decides whether its own label
still stands in the text at its turn (a label may be part of another).  All labels without
such a dependency are one level and can be asked for together, on any number of pages.

``pooled`` keeps as many pages open as a batch needs and asks for full batches, whatever
pages and levels their labels belong to; only a task's last batches are smaller.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

from .prompts import CONTEXT_CHARS, prompt

#: Stands for a caption that is not known yet; a noncharacter.
HOLE = "\U0010ffff"
KEEP = object()


class Failed(str):
    """The error of a caption."""


class Fold:
    """One page: its text so far, and what is known of its labels' captions.

    A label of ``kept`` has no caption and stays.  A failed caption ends the page with the
    captions before it.  Labels have the marker's form: none begins inside another.
    """

    def __init__(self, text: str, labels: list[str], kept: Iterable[int] = ()) -> None:
        self.text, self.labels = text, labels
        self.told: list[str | object | None] = [None] * len(labels)
        for k in kept:
            self.told[k] = KEEP
        self.asked: set[int] = set()
        self.reach = CONTEXT_CHARS + max(map(len, labels), default=0)
        self.at, self.error = 0, None
        self._advance()

    @property
    def done(self) -> bool:
        return self.at == len(self.labels)

    def tell(self, k: int, caption: str) -> None:
        self.told[k] = caption
        self._advance()

    def _advance(self) -> None:
        """Folds what is known, in order."""
        while not self.done:
            label, told = self.labels[self.at], self.told[self.at]
            if label in self.text:
                if told is None:
                    return
                if isinstance(told, Failed):
                    self.at, self.error = len(self.labels), str(told)
                    return
                if told is not KEEP:
                    self.text = self.text.replace(label, told)
            self.at += 1

    def ready(self) -> list[tuple[int, str]]:
        """(label's number, prompt) of the labels that can be asked for and have not been."""
        out: list[tuple[int, str]] = []
        if HOLE in self.text:  # cannot stand for anything here: one after the other
            if not self.done and self.at not in self.asked:
                out.append((self.at, prompt(self.text)))
        else:
            text = self.text
            for k in range(self.at, len(self.labels)):
                label, told = self.labels[k], self.told[k]
                if label not in text:
                    continue  # gone, or decided by a caption that is not known yet
                if isinstance(told, Failed):
                    break
                if told is None:
                    if k not in self.asked and HOLE not in text[: self.reach]:
                        out.append((k, prompt(text)))
                    text = text.replace(label, HOLE)
                elif told is not KEEP:
                    text = text.replace(label, told)
        self.asked.update(k for k, _ in out)
        return out


def pooled(pages: Iterator[tuple], call: Callable[[list[tuple]], list[tuple]], batch: int) -> Iterator[tuple]:
    """(key, fold) of each of the pages (key, fold, what the captioner is given for each label).

    ``call`` takes (prompt, given) of up to ``batch`` labels and returns (caption, error) of each.
    """
    open_: dict[int, tuple] = {}
    waiting: deque[tuple[int, int, str]] = deque()
    number, more = 0, True
    while True:
        while more and len(waiting) < batch:
            page = next(pages, None)
            if page is None:
                more = False
            elif page[1].done:
                yield page[:2]
            else:
                open_[number] = page
                waiting.extend((number, *r) for r in page[1].ready())
                number += 1
        if not waiting:
            return
        taken = [waiting.popleft() for _ in range(min(batch, len(waiting)))]
        taken = [t for t in taken if t[0] in open_]  # a failed page has no need of the rest
        if not taken:
            continue
        found = call([(told, open_[n][2][k]) for n, k, told in taken])
        for (n, k, _), (caption, error) in zip(taken, found, strict=True):
            if n in open_:
                fold = open_[n][1]
                fold.tell(k, caption if error is None else Failed(error))
                if fold.done:
                    yield open_.pop(n)[:2]
        for n in dict.fromkeys(t[0] for t in taken):
            if n in open_:
                waiting.extend((n, *r) for r in open_[n][1].ready())
