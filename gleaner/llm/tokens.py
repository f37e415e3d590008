"""Token ids of whole texts by a public tokenizer file, a cached chunk at a time."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a Python worker's cache; it is emptied when full, which changes no result.
CACHE = 600_000
#: Bytes of text whose words are told apart at once; a longer text is a part of its own.
PART = 8 << 20
# A run of Latin letters that lower-casing and NFC treat alike everywhere, then ASCII punctuation without apostrophes.
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)\z"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The characters that byte-level tokenizers use for bytes: printable Latin-1 stays, the others follow U+0100."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in stay)}


class WordIds:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The tokenizer must drop white space and treat what stands between white space alone, as lower-casing word
    tokenizers do.  All ids come from the library: runs of Latin letters from its model, every other chunk from its
    whole pipeline.  Chunks end at ASCII white space; other white space is inside a chunk and left to the pipeline.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tok = Tokenizer.from_str(content)
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.mark = self.bare.encode(",").ids
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32
        self.stems: dict[str, bytes] = {}
        self.letters = byte_letters() | {32: " "}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, stems: list[str]) -> None:
        """Ids of runs of lower-case letters by the bare model, which sees them all at once with commas between."""
        text = " , ".join(stems)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)) * ids.itemsize
        starts = np.append(0, ends[:-1] + ids.itemsize)
        data = ids.tobytes()
        self.stems.update(zip(stems, (data[p:q] for p, q in zip(starts.tolist(), ends.tolist(), strict=True)), strict=True))

    def of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of different chunks as bytes: of a stem and what follows it, else by the whole pipeline."""
        found = pc.extract_regex(chunks, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        stem = pc.utf8_lower(found.filter(plain).field("stem")).dictionary_encode()
        rest = found.filter(plain).field("rest").dictionary_encode()
        stems, known = stem.dictionary.to_numpy(zero_copy_only=False).tolist(), self.stems
        new = [s for s in stems if s not in known]
        for lo in range(0, len(new), 16_384):  # what the library holds of a word is many times its length
            self.learn(new[lo : lo + 16_384])
        first = pa.array(map(known.__getitem__, stems), pa.large_binary()).take(stem.indices)
        last = pa.array(map(self.whole, rest.dictionary.to_pylist()), pa.large_binary()).take(rest.indices)
        odd = pa.array(map(self.whole, chunks.filter(~plain).to_pylist()), pa.large_binary())
        if len(known) > CACHE:
            known.clear()
        place = np.empty(len(chunks), np.int64)
        place[plain], place[~plain] = np.arange(len(first)), np.arange(len(odd)) + len(first)
        return pa.concat_arrays([pc.binary_join_element_wise(first, last, pa.scalar(b"", pa.large_binary())), odd]).take(pa.array(place))

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, and how many each has; a null text has none."""
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        ids, width = self.of_chunks(coded.dictionary).take(coded.indices), np.dtype(self.dtype).itemsize
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
        data = np.frombuffer(ids.buffers()[2], self.dtype, int(ends[-1]) // width) if ends[-1] else np.zeros(0, self.dtype)
        at = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)))
        return data, np.diff(ends[at]) // width

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of ``texts`` of about ``PART`` bytes, with what ``many`` tells of them."""
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PART, "right")))
            yield lo, hi, *self.many(texts.slice(lo, hi - lo))
            lo = hi

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]

    def forget(self) -> None:
        """Empty the cache, which would stand beside the next stage's memory: Spark keeps its workers."""
        self.stems = {}


_loaded: dict[int, WordIds] = {}


def word_ids(content: str) -> WordIds:
    """The one of this Python worker."""
    if (k := hash(content)) not in _loaded:
        _loaded.clear()
        _loaded[k] = WordIds(content)
    return _loaded[k]
