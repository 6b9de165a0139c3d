"""Token ids of texts by the tokenizers library, with a cache of ids for each piece between white space.

The vocabulary's rule never joins characters across white space and merges each word alone, so a text's ids are those of
its pieces in a row. Frequent pieces repeat, and their ids are kept as little-endian bytes: a text becomes a split, lookups
and one join; the library merges words that are not known yet. Texts with anything for which that could differ (marks of
special tokens, characters outside the plain Latin range) go to the library whole, and so do all texts where a vocabulary
file states other rules than these.
"""

from __future__ import annotations

import json
import re
from array import array

END_ID = 1
TOKENIZER = "word_bpe_49k.json"

#: Anything else than these characters sends a text to the library whole.
_PLAIN = re.compile(r"[\t\n\r !-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017e]*")
#: The vocabulary's own rule for words, as it reads on those characters.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Entries of a worker's cache; about 60 MB.
_LIMIT = 400_000
# The steps of the vocabulary file that the rule above stands for.
_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest in order from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


def follows_rule(path: str) -> bool:
    """Whether a vocabulary file states the rule of this module, and marks special tokens by <| only."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    marks = all("<|" in t["content"] for t in stated.get("added_tokens", []))
    return marks and not stated["model"].get("dropout") and all(stated.get(k) == v for k, v in _STEPS.items())


class _Pieces(dict):
    """Piece between white space -> ids of its words. A lower-case word is a piece as well, so one table holds both."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.letters = merge, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        lower = piece.lower()
        words = [lower] if lower.isalpha() else _WORDS.findall(lower)
        found = b"".join([self.get(w) or self.word(w) for w in words])
        if len(self) < _LIMIT:
            self[piece] = found
        return found

    def word(self, word: str) -> bytes:
        """Ids of a new word by the library's merges."""
        ids = self.merge(word.encode().decode("latin-1").translate(self.letters))
        found = array("I", [t.id for t in ids]).tobytes()
        if len(self) < _LIMIT:
            self[word] = found
        return found


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers, the end id included."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = array("I", [end_id]).tobytes()
        self.plain = follows_rule(path)
        self.pieces = _Pieces(self.tokenizer.model.tokenize)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null counts as empty."""
        if not text:
            return self.end
        if not self.plain or "<|" in text or not _PLAIN.fullmatch(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        return b"".join(map(self.pieces.__getitem__, text.split())) + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
