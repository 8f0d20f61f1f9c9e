"""Word-end BPE by a priority queue of merge ranks over a doubly linked list of symbols.

A text is normalized and cut into words as the vocabulary file says; each word becomes byte letters, the
last with the word-end mark. Adjacent pairs that have a rank wait in a heap by (rank, place). The
best is merged: the left symbol takes the new id, the right one leaves the list, and the two new
neighbourhoods are pushed; entries whose symbols have changed since are skipped when they come up.
A word of n symbols costs n log n, however long. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matchrank.llm.arrow import per_document, text_rows
from matchrank.llm.bytebpe import byte_letters

# fixed values: how the vocabulary file normalizes and cuts; anything else is refused
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same expression for ASCII text in lower case, and with white space as Unicode defines it.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
UNICODE_WORDS = WORDS.replace(r"\s", r"\p{White_Space}")
#: Words whose ids a worker remembers in each of two generations, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 1 << 18, 64


def settled(char: str) -> bool:
    """Assigned in Unicode 3.2 and of the same class since: every library's tables agree on it."""
    return unicodedata.category(char) == unicodedata.ucd_3_2_0.category(char) != "Cn"


class Memo(dict):
    """Ids by word. A full generation becomes the old one, from which words come back as they recur."""

    def __init__(self, make: Callable[[str], list[int]]):
        self._make, self._old = make, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self._old.get(word) or tuple(self._make(word))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self._old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    """Ids of texts, exactly as the tokenizers library gives them without added ids, and back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        split, letters = told["pre_tokenizer"]["pretokenizers"]
        same = (
            [n["type"] for n in told["normalizer"]["normalizers"]] == NORMALIZERS and split["pattern"]["Regex"] == WORDS and split["invert"] and letters["type"] == "ByteLevel"
            and not letters["add_prefix_space"] and told["decoder"] is None and told["post_processor"] is None and model["dropout"] is None and not any(model[k] for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        )
        if not same:
            raise ValueError(f"{path} isn't a vocabulary of this kind")
        self._lib = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        #: (left id, right id) to (rank, new id)
        self._merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        letter = {b: c for c, b in byte_letters().items()}
        self._inner = [vocab[letter[b]] for b in range(256)]
        self._last = [vocab[letter[b] + self.end] for b in range(256)]
        self._special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self._special.items()}
        self._around = re.compile("(" + "|".join(map(re.escape, self._special)) + ")").split if self._special else lambda t: [t]
        self._ascii, self._unicode = re.compile(ASCII_WORDS).findall, regex.compile(UNICODE_WORDS).findall
        self._letters_back = byte_letters()
        self._decimals = {i: str(i) for i in self.strings}
        self._settled: set[str] = set()
        self._ids = Memo(self.merge).__getitem__

    def words(self, text: str) -> list[bytes | str]:
        """The words of a stretch without special tokens, in order, normalized."""
        if text.isascii():
            return self._ascii(text.lower())
        new = set(text) - self._settled
        if all(map(settled, new)):
            self._settled |= new
            # letter by letter a capital sigma is never final
            return self._unicode(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        # characters on which Unicode tables may differ: the library's own tables cut the words
        cut = self._lib.pre_tokenizer.pre_tokenize_str(self._lib.normalizer.normalize_str(text))
        return [bytes(self._letters_back[c] for c in w).decode("utf-8") for w, _ in cut]

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        data = word.encode()
        ids = [self._inner[b] for b in data[:-1]] + [self._last[data[-1]]]
        n = len(ids)
        following, previous = [*range(1, n), -1], [*range(-1, n - 1)]
        ranks = self._merges.get
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := ranks((ids[k], ids[k + 1])))]
        heapify(heap)
        while heap:
            _, at, left, right, new = heappop(heap)
            after = following[at]
            if ids[at] != left or after < 0 or ids[after] != right:
                continue  # stale: a symbol was merged or has left the list
            ids[at], ids[after] = new, -1
            beyond = following[at] = following[after]
            if beyond >= 0:
                previous[beyond] = at
                if found := ranks((new, ids[beyond])):
                    heappush(heap, (found[0], at, new, ids[beyond], found[1]))
            before = previous[at]
            if before >= 0 and (found := ranks((ids[before], new))):
                heappush(heap, (found[0], before, ids[before], new, found[1]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special tokens in it have theirs."""
        out: list[int] = []
        for stretch in self._around(text):
            if stretch in self._special:
                out.append(self._special[stretch])
            elif stretch:
                out.extend(chain.from_iterable(map(self._ids, self.words(stretch))))
        return out

    def decimal(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self._decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by spaces, special ones too; ids outside the vocabulary have none."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec per worker process and vocabulary."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked, ``ids`` and ``decoded``.

    ``ids_sha256`` is over decimal ids joined by one space. Null or empty text, and text of white
    space, has no ids and decodes to the empty text. Rows are independent: repeated ids give repeated
    rows, a null id stays null, texts and words of any length are encoded whole, an empty table gives no
    rows, other columns are ignored. ``vocabulary`` must lead to the same file on every worker.
    """
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        kind += ", ids array<int>, decoded string"

    def make():
        c = codec(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

        def work(ids: list, texts: list[str]) -> dict:
            out: dict[str, list] = {name: [] for name, _ in schema}
            out["doc_id"] = ids
            for text in texts:
                coded = c.encode(text)
                back = c.decode(coded)
                row = {"n_tokens": len(coded), "ids_sha256": sha(c.decimal(coded)), "decoded_sha256": sha(back)}
                for name, value in (row | ({"ids": coded, "decoded": back} if with_ids else {})).items():
                    out[name].append(value)
            return out

        return work

    return per_document(text_rows(docs, id_col, text_col), make, pa.schema(schema), kind)
