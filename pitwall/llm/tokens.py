"""Token ids of whole texts, exact to the tokenizers library and remembered word by word.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts. So a text
is cut into the same pieces here, each distinct piece is encoded once by the
library, and a text's ids are the joined ids of its pieces. Texts with characters
outside the plain Latin range are cut at white space only, which every
pre-tokenizer here respects too. New pieces are encoded some hundred at a time,
glued by white space that no merge crosses.
"""

from __future__ import annotations

import re

import numpy as np

# Latin letters, and the other characters that are neither letter, number, mark nor white space.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_P = "!-/:-@\\[-`{-~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
# White space as the tokenizers see it; Python's \s has four separators more.
_W = r"[^\S\x1c-\x1f]"
_N = r"[\S\x1c-\x1f]"
_ODD = re.compile(f"[^{_L}{_P}0-9 \\t\\n\\r]")
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_SPACES = f"{_W}+(?!{_N})|{_W}"

_FINE = {
    "byte": re.compile(f"{_SHORT}| ?[{_L}]+| ?[0-9]+| ?[{_P}]+|{_SPACES}"),
    "word": re.compile(f"{_SHORT}|[{_L}]+|[0-9]|[{_P}]+"),
}
_COARSE = {"byte": re.compile(f" ?{_N}+|{_SPACES}"), "word": re.compile(f"{_N}+")}

_encoders: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """``kind`` is "byte" for a byte-level vocabulary that keeps white space, "word" for one that drops it."""

    # Half of them young, half of them old; a slice's own come on top. Some 150 bytes each.
    MAX_WORDS = {"byte": 800_000, "word": 300_000}

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self._tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._fine, self._coarse, self._lower = _FINE[kind], _COARSE[kind], kind == "word"
        self.MAX_WORDS = self.MAX_WORDS[kind]
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        # How words that are encoded together are told apart again.
        self._glue = " " if self._lower else "\n"
        self._feed = self._tok.encode("\n", add_special_tokens=False).ids[:1]
        self._ends = np.zeros(1 << 16 if self.dtype.itemsize == 2 else self._tok.get_vocab_size(), bool)
        if self._lower:
            self._ends[[i for t, i in self._tok.get_vocab().items() if t.endswith("</w>")]] = True

    def _learn(self, fine: list[list[str]], coarse: list[list[str]]) -> None:
        plain, odd = set().union(*fine), set().union(*coarse)
        if 2 * len(self._known) > self.MAX_WORDS:  # what has not been met since the last time is forgotten
            self._known, self._old = {}, self._known
        new = plain.difference(self._known), odd.difference(self._known)
        for w in (new[0] | new[1]).intersection(self._old):
            self._known[w] = self._old[w]
        new = new[0].difference(self._known), new[1].difference(self._known)
        spaces = {w for w in new[0] if w.isspace()}
        self._each(list(new[1] | spaces))
        words = list(new[0] - spaces)
        together = [words[i:i + 200] for i in range(0, len(words), 200)]
        coded = self._tok.encode_batch_fast([self._glue.join(w) for w in together], add_special_tokens=False)
        for some, e in zip(together, coded):
            self._several(some, np.array(e.ids, self.dtype))

    def _each(self, words: list[str]) -> None:
        for w, e in zip(words, self._tok.encode_batch_fast(words, add_special_tokens=False)):
            self._known[w] = np.array(e.ids, self.dtype).tobytes()

    def _several(self, words: list[str], ids: np.ndarray) -> None:
        """Part the ids of words encoded together: after a word's end, or at the line feeds between them."""
        if self._lower:
            ends = np.flatnonzero(self._ends[ids]) + 1
            starts = np.concatenate([[0], ends[:-1]])
        else:
            feeds = np.flatnonzero(ids == self._feed)
            starts, ends = np.concatenate([[0], feeds + 1]), np.append(feeds, len(ids))
        if len(ends) != len(words):
            return self._each(words)
        raw, size = ids.tobytes(), self.dtype.itemsize
        for w, a, b in zip(words, (size * starts).tolist(), (size * ends).tolist()):
            self._known[w] = raw[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``self.dtype`` wide."""
        odd = [_ODD.search(t) is not None for t in texts]
        cut = [self._coarse.findall(t) if o else self._fine.findall(t.lower() if self._lower else t)
               for t, o in zip(texts, odd)]
        self._learn([c for c, o in zip(cut, odd) if not o], [c for c, o in zip(cut, odd) if o])
        get = self._known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]


def encoder(path: str, kind: str) -> Encoder:
    """One per Python worker, so that its words outlive a task."""
    key = (path, kind)
    if key not in _encoders:
        _encoders[key] = Encoder(path, kind)
    return _encoders[key]
