"""Token counts of a sentencepiece BPE model: whole texts in, lengths only out.

No piece of such a vocabulary has the space sign after another sign. A text can therefore be cut in
front of every run of spaces, and its count is the sum over the cuts. Cuts are encoded in calls of
about the same number of bytes, and the count of a cut is remembered, so that a frequent word is
encoded once; words over ``LONGEST`` characters are not remembered. A model that does have pieces across words
gets its texts uncut.

NULL texts count as empty and have no tokens. Special strings inside a text are plain text. Equal texts have equal
counts, and an empty table gives no rows.
"""

from __future__ import annotations

import re

import sentencepiece
from pyspark.sql import DataFrame

from siteroster.llm.common import add_columns

SPACE = "▁"
#: Bytes of text per call of the tokenizer.
CALL_BYTES = 1 << 18
_CACHE_ROOM, LONGEST = 400_000, 64


class Counter:
    """Counts tokens of texts with one model; remembers the counts of words."""

    _runs = re.compile(r" +[^ ]*|[^ ]+")

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.safe = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self._prefixed()
        self.lone_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.known: dict[str, int] = {}

    def _prefixed(self) -> bool:
        """Whether a space is put before each text, and spaces and signs are otherwise left alone."""
        same = [self.model.encode(x, out_type=str) for x in ("a", " a", "  a", "Ａ")]
        return ["".join(x) for x in same[:3]] == [SPACE + "a", SPACE * 2 + "a", SPACE * 3 + "a"] and (
            self.model.decode(self.model.encode("Ａ")) == "Ａ")

    def cuts(self, text: str) -> list[str]:
        """Parts of a text, each encoded with one space put before it."""
        text = text.replace(SPACE, " ")
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        first, *rest = self._runs.findall(text)
        return [first, *[x[1:] for x in rest]]  # leading spaces of the text join the one put before it

    def learn(self, words: set[str]) -> None:
        """Encode words in calls of about CALL_BYTES."""
        call, size = [], 0
        for word in words:
            call.append(word)
            size += len(word.encode()) + 8
            if size >= CALL_BYTES:
                self._encode(call)
                call, size = [], 0
        if call:
            self._encode(call)

    def _encode(self, call: list[str]) -> None:
        self.known.update(zip(call, map(len, self.model.encode(call, num_threads=1))))

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)]
        parts = [self.cuts(t) if t else [] for t in texts]
        if len(self.known) > _CACHE_ROOM:
            self.known.clear()
        known = self.known
        known[""] = self.lone_space  # a cut that is one space
        new = {w for p in parts for w in p if w not in known}
        self.learn(new)
        counts = [sum(map(known.__getitem__, p)) for p in parts]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return counts


_open: dict[str, Counter] = {}


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens, and over_limit: more tokens than ``limit``.

    ``path`` is the model file, installed at the same place on every worker.
    """
    def score(texts):
        if path not in _open:
            _open[path] = Counter(path)
        n = _open[path].counts(texts)
        return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}
    return add_columns(df, text, "n_bytes long, n_tokens long, over_limit boolean", score)
