"""Token ids of texts by a public byte-level BPE tokenizer, with a memo of frequent pieces.

The tokenizer's pattern starts a new piece at a single space between two visible characters, whatever
stands around it, and at a single line feed between two. Texts are therefore cut there and the ids of each
piece are kept: most pieces of a corpus repeat, and the tokenizer sees only the others. A text with other
white space beside a space or line feed, or with the string of one of the tokenizer's added tokens (which it
gives that token's id), is encoded whole.
"""

from __future__ import annotations

from array import array

import numpy as np

from notewright.llm.shared import kept, parts

END = 2  #: the id that ends each document
MEMO = 600_000  #: pieces kept at most; a full memo is emptied
_PLAIN = "\u0590"  #: letters below are letters to every library
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  #: fixed value: ASCII punctuation but the apostrophe
#: Characters that one library takes for white space and another doesn't.
_DOUBTFUL = set("\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_signs() -> dict[int, str]:
    """The sign of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


class _Memo(dict):
    """Ids of pieces, encoded as they come up; no bytes for a piece that can't be cut off."""

    def __init__(self, ids_of, word_ids):
        super().__init__()
        self.ids_of, self.word_ids, self.marks = ids_of, word_ids, {}

    def __missing__(self, piece: str) -> bytes:
        body = piece[1:] if piece[:1] == "\n" else piece
        if not body or body[0].isspace() or body[-1].isspace() or body[0] in _DOUBTFUL or body[-1] in _DOUBTFUL:
            ids = b""
        elif body.isalpha() and max(body) < _PLAIN:
            ids = self.word_ids(body, piece is body)
        else:
            stem = piece.rstrip(_MARKS)  # marks after a letter or digit are pieces of their own
            if len(stem) < len(piece) and stem and (stem[-1].isalpha() or stem[-1] in "0123456789"):
                marks = piece[len(stem) :]
                if marks not in self.marks:
                    self.marks[marks] = self.ids_of(marks)
                ids = self[stem] + self.marks[marks]
            else:
                ids = self.ids_of(piece if piece[0] == "\n" else " " + piece)
        self[piece] = ids
        return ids


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.signs = self.tokenizer.model, _byte_signs()
        self.line_feed = self.ids_of("\n")
        self.memo = _Memo(self.ids_of, self.word_ids)

    def ids_of(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word_ids(self, word: str, after_space: bool) -> bytes:
        """Ids of a run of letters behind a space or else a line feed: one piece of the pattern, so the merges alone are run."""
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        ids = array("I", [t.id for t in self.model.tokenize(self.signs[32] + signs if after_space else signs)]).tobytes()
        return ids if after_space else self.line_feed + ids

    def encode(self, text: str) -> bytes:
        pieces = text.replace("\n", " \n").split(" ")
        if len(pieces) == 1 or any(t in text for t in self.added):
            return self.ids_of(text)
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.memo.marks.clear()
        ids = list(map(self.memo.__getitem__, pieces))
        if b"" in ids:
            return self.ids_of(text)
        ids[0] = self.ids_of(pieces[0])
        return b"".join(ids)


def encoded(batches, path: str):
    """(batch, list of ids as bytes, with END) for parts of the batches of a bounded size."""
    encoders, end = kept("tokens"), np.array([END], "<u4").tobytes()
    encoder = encoders[path] = encoders.get(path) or Encoder(path)
    for batch in parts(batches):
        texts, ids, start, size = batch.column("text"), [], 0, 0
        for i, text in enumerate(texts.to_pylist()):
            ids.append(encoder.encode(text or "") + end)
            size += len(ids[-1])
            if size > 1 << 22:
                yield batch.slice(start, i + 1 - start), ids
                ids, start, size = [], i + 1, 0
        if ids:
            yield batch.slice(start), ids
