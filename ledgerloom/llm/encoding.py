"""Token ids of texts from a tokenizer file, by way of a memory of segments.

A byte-level BPE of the usual split pattern starts a new pre-token at every
space that a non-space character follows, whatever stands before it, and a
single line feed between two non-space characters is a pre-token of its own.
Those places are safe boundaries.  A text whose white space is only of these two
kinds is cut there; its segments are looked up in a bounded memory, and all
segments of a batch that are not in it are encoded together by the tokenizer.
All other texts, and those holding an added token's string, go to the tokenizer
itself, long ones in parts that end at a safe boundary: before a space that a letter or
digit follows or, where no added token's string is in the text, between a letter and
a sign or digit.

Whether a file is of that kind is read from the file: others are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

#: White space other than the space and the line feed.
_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Segments kept in a worker's memory; at the bound it starts anew.
MEMORY_ENTRIES = 300_000
#: Characters sent to the tokenizer in one string.
CHUNK_CHARS = 1 << 15
#: Characters of a text from which on it is encoded in parts.
LONG_CHARS = 1 << 16
_SPACE_BOUNDARY = re.compile(r" (?=[^\W_])")
_LETTER_END = re.compile(r"(?<=[^\W\d_])(?=[0-9!-/:-@\[-`{-~])")


def usual_pattern(path: str) -> bool:
    """Whether a tokenizers file is a byte-level BPE that splits by the usual pattern and changes no text before."""
    described = json.load(open(path, encoding="utf-8"))
    split, model = described.get("pre_tokenizer") or {}, described.get("model") or {}
    plain = described.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    bpe = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    bare = all(t["content"] and not t["content"][0].isalnum() and not any(c.isspace() for c in t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in described.get("added_tokens") or [])
    return bool(plain and bpe and bare)


def _byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class SegmentEncoder:
    """Ids of whole texts for a byte-level BPE file (tokenizers JSON).

    keep_ids: the ids as little-endian 32-bit bytes, else their number.
    ranked: encode new segments from the file's vocabulary as ranks, which is
    the same encoding by a faster library; whole texts still go to tokenizers.
    """

    def __init__(self, path: str, keep_ids: bool, ranked: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep_ids = keep_ids
        self.usual = usual_pattern(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        starts = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
        for token, i in vocabulary.items():
            starts[i] = token[0] in "ĠĊ"  # how the file writes a leading space or line feed
        self.starts = starts
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory: dict[str, object] = {}
        self.ranks = self._ranks(path, vocabulary) if ranked and self.usual else None

    def _ranks(self, path: str, vocabulary: dict[str, int]) -> object:
        import public_tokenizers
        import tiktoken

        alphabet = _byte_alphabet()
        special = {t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _value(self, ids: list[int]) -> object:
        return np.asarray(ids, dtype="<u4").tobytes() if self.keep_ids else len(ids)

    def _whole(self, texts: list[str]) -> list[object]:
        """Texts encoded by the tokenizer itself; long ones in parts, of which no more than about a text's length is held at once."""
        out: list[object] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG_CHARS or not self.usual]
        for i, e in zip(short, self.tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
            out[i] = self._value(e.ids)
        for i, t in enumerate(texts):
            if out[i] is None:
                found = [self._value(self.tokenizer.encode_batch_fast([p], add_special_tokens=False)[0].ids) for p in self._parts(t)]
                out[i] = b"".join(found) if self.keep_ids else sum(found)
        return out

    def _parts(self, text: str) -> Iterable[str]:
        """The text in parts of about CHUNK_CHARS that end at safe boundaries."""
        bare = not any(s in text for s in self.special)
        at = 0
        while len(text) - at > CHUNK_CHARS:
            found = _SPACE_BOUNDARY.search(text, at + CHUNK_CHARS)
            if bare and (found is None or found.start() > at + 2 * CHUNK_CHARS):
                found = _LETTER_END.search(text, at + CHUNK_CHARS) or found
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _ids(self, text: str) -> list[int]:
        if self.ranks is not None:
            return self.ranks.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[str]) -> None:
        """Add segments to the memory, many of them to a string for the tokenizer."""
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and chars < CHUNK_CHARS:
                chars += len(new[end]) + 1
                end += 1
            part = new[at:end]
            ids = np.asarray(self._ids("".join([s if s[:1] == "\n" else " " + s for s in part])), dtype="<u4")
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(part) and first[0] == 0:
                if self.keep_ids:
                    raw, ends = ids.tobytes(), np.append(first[1:], len(ids)) * 4
                    for s, a, b in zip(part, (first * 4).tolist(), ends.tolist(), strict=True):
                        self.memory[s] = raw[a:b]
                else:
                    for s, n in zip(part, np.diff(np.append(first, len(ids))).tolist(), strict=True):
                        self.memory[s] = n
            else:
                for s in part:
                    self.memory[s] = self._value(self._ids(s if s[:1] == "\n" else " " + s))
            at = end

    def _plain(self, text: str) -> bool:
        """Whether all white space of the text is single spaces and single line feeds inside it."""
        return self.usual and not (
            text == ""
            or text[0] in " \n"
            or text[-1] in " \n"
            or "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or _ODD_SPACE.search(text)
            or any(s in text for s in self.special)
        )

    def encode(self, texts: list[str]) -> list[object]:
        """For each text its number of ids or, with keep_ids, the ids as bytes."""
        if len(self.memory) > MEMORY_ENTRIES:
            self.memory.clear()
        get = self.memory.get
        out: list[object] = [None] * len(texts)
        whole: list[int] = []
        cuts: list[tuple[int, list[str], list[object]]] = []
        new: set[str] = set()
        for i, text in enumerate(texts):
            if not self._plain(text):
                whole.append(i)
                continue
            # A line feed put before the text makes its first segment like that of any other line.
            cut = ("\n" + text).replace("\n", " \n")[1:].split(" ")
            values = list(map(get, cut))
            if None in values:
                new.update([s for s, v in zip(cut, values, strict=True) if v is None])
            cuts.append((i, cut, values))
        if new:
            self._learn(list(new))
        for i, cut, values in cuts:
            if None in values:
                values = list(map(get, cut))
            out[i] = b"".join(values)[4:] if self.keep_ids else sum(values) - 1
        if whole:
            for i, v in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
                out[i] = v
        return out


def by_bytes(texts: list[str], most: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of consecutive texts of about equal UTF-8 bytes, so that batches cost alike."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += (len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))) + 16
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


_encoders: dict[tuple[str, bool, bool], SegmentEncoder] = {}


def encoder_of(path: str, keep_ids: bool, ranked: bool = False) -> SegmentEncoder:
    """The worker's encoder: a worker that is used again keeps its tokenizer and its bounded memory."""
    key = (path, keep_ids, ranked)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = SegmentEncoder(path, keep_ids, ranked)
    return _encoders[key]
