"""Token ids of whole texts, each distinct word encoded once per worker."""

import re

import numpy as np

from flowspark.llm.common import tokenizer

# What the tokenizer file says of its splitting, and what it comes to for
# texts of printable ASCII and Latin letters, which this module splits itself.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_MOST_CHUNKS, _MOST_PIECES = 500_000, 700_000


class WordIds:
    """Ids without special tokens, equal to `encode(text, add_special_tokens=False)`.

    White space always ends a word in these tokenizers and leaves no id, so the ids of a
    text are those of its blank-separated chunks in turn. Chunks are looked up in a table;
    unknown ones are cut into pre-tokens, and unknown pre-tokens are encoded together and
    parted where the vocabulary marks a word's end. A table that is full starts anew, which
    costs time only. Any other tokenizer file is applied to each text as it is.
    """

    def __init__(self, path):
        import json

        self.encoder = tokenizer(path)
        with open(path) as file:
            stated = json.load(file)
        kinds = [x.get("type") for x in (stated.get("normalizer") or {}).get("normalizers", [])]
        steps = (stated.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        end = stated["model"].get("end_of_word_suffix")
        self.by_word = bool(
            kinds == ["NFC", "Replace", "Lowercase"] and end
            and (steps[0].get("pattern") or {}).get("Regex") == SPLIT
            and all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in stated["added_tokens"])
        )
        vocabulary = self.encoder.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        if end:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def of(self, texts):
        """The ids of each text (UTF-8 bytes or null), packed as little-endian `dtype`."""
        if not self.by_word:
            found = self.encoder.encode_batch_fast([(t or b"").decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in found]
        parted = [t.split() if t else [] for t in texts]
        if len(self.chunks) > _MOST_CHUNKS:
            self.chunks.clear()
        if len(self.pieces) > _MOST_PIECES:
            self.pieces.clear()
        unknown = set()
        for p in parted:
            unknown.update(p)
        unknown.difference_update(self.chunks)
        self._learn(unknown)
        get = self.chunks.__getitem__
        return [b"".join(map(get, p)) for p in parted]

    def _learn(self, chunks):
        split, new = {}, {}
        for chunk in chunks:
            text = chunk.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                split[chunk] = pieces = _PIECES.findall(text.lower())
                for p in pieces:
                    if p not in self.pieces:
                        new[p] = None
            else:
                ids = self.encoder.encode(text, add_special_tokens=False).ids
                self.chunks[chunk] = np.array(ids, self.dtype).tobytes()
        new = list(new)
        for at in range(0, len(new), 500_00):
            self._encode(new[at:at + 500_00])
        get = self.pieces.__getitem__
        for chunk, pieces in split.items():
            self.chunks[chunk] = get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces))

    def _encode(self, pieces):
        blocks = [pieces[i:i + 500] for i in range(0, len(pieces), 500)]
        found = self.encoder.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, found):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(block) or ends[-1] != len(ids):
                for p in block:
                    self.pieces[p] = np.array(
                        self.encoder.encode(p, add_special_tokens=False).ids, self.dtype).tobytes()
                continue
            packed, width, start = ids.tobytes(), self.dtype.itemsize, 0
            for p, stop in zip(block, ends.tolist()):
                self.pieces[p] = packed[start * width:stop * width]
                start = stop


_made: dict[str, WordIds] = {}


def word_ids(path) -> WordIds:
    """The worker's own encoder for a vocabulary file; it and its tables outlive a task."""
    if path not in _made:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _made[path] = WordIds(path)
    return _made[path]
