"""Token ids and counts of whole texts with a byte-level BPE vocabulary.

Three facts about the vocabulary are proven offline, on the driver, before any text
is read:

* ``whole_tokens``: the strings that the library leaves in one pre-token and encodes
  to their own id alone. Such a pre-token counts one, without a merge.
* ``merges_alike``: merging by the rank of the result, as the fast merger does, gives
  the library's ids. The library joins only listed pairs, least rank first. The
  fast merger could differ only by joining an unlisted pair whose concatenation is
  a token. Inside the span of that token no pair crosses its ends, so the span went
  through the same states as the token's own bytes would alone. It is enough,
  then, that every token's bytes, merged with the ranks below its own, end as its
  listed pair. Without that proof the library merges everything.
* the pre-tokenizer of the file is the public pattern, without normalization.

Texts with special strings, or with characters beyond ``PLAIN``, where pattern
engines of different age could disagree, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from vitrine.llm.common import ship_by_value, text_blocks

ship_by_value(__name__)

VOCABULARY = "byte_bpe_50k.json"
#: Distinct pre-tokens whose counts a task remembers before it starts afresh.
MEMO = 500_000
PLAIN = r"[\t\n\x20-\x7e¡-ɏ]*"


@dataclass
class Vocabulary:
    """A tokenizer file and what is proven about it; sent to the tasks."""
    file: str
    whole: frozenset[str]
    alike: bool


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 signs are
    themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of(file: dict) -> dict[bytes, int]:
    letters = byte_letters()
    special = {t["content"] for t in file["added_tokens"]}
    return {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}


def merges_alike(file: dict) -> bool:
    model, pre = file["model"], file["pre_tokenizer"] or {}
    if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or file["normalizer"] or model.get("ignore_merges") or model.get("byte_fallback")):
        return False
    letters = byte_letters()
    ranks = ranks_of(file)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = [tuple(bytes(letters[c] for c in part) for part in pair) for pair in pairs]
    made = [ranks.get(a + b) for a, b in pairs]
    if None in made or made != sorted(set(made)) or len(made) + 256 != len(ranks):
        return False
    for (a, b), rank in zip(pairs, made):
        parts = [bytes([x]) for x in a + b]
        while True:
            joined = [ranks.get(x + y, rank) for x, y in zip(parts, parts[1:])]
            least = min(joined)
            if least >= rank:
                break
            i = joined.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if parts != [a, b]:
            return False
    return True


def whole_tokens(file: str) -> frozenset[str]:
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_str(file)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
    alone = []
    for at in range(0, len(texts), 2000):  # few encodings at once: the driver is small
        encoded = tokenizer.encode_batch(texts[at:at + 2000], add_special_tokens=False)
        alone += [texts[at + k] for k, e in enumerate(encoded) if e.ids == [at + k] and texts[at + k] not in special]
    return frozenset(t for t in alone if len(tokenizer.pre_tokenizer.pre_tokenize_str(t)) == 1)


def read_vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The tokenizer file, read once on the driver, and its proofs."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        file = f.read()
    return Vocabulary(file, whole_tokens(file), merges_alike(json.loads(file)))


class Encoder:
    """One task's encoder."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        file = json.loads(vocabulary.file)
        self.library = Tokenizer.from_str(vocabulary.file)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.is_plain = re.compile(PLAIN).fullmatch if vocabulary.alike else lambda text: None
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.merger = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                        mergeable_ranks=ranks_of(file)) if vocabulary.alike else None
        self.whole = dict.fromkeys(vocabulary.whole, 1)
        self.counts_of = dict(self.whole)

    def _simple(self, text: str) -> bool:
        return self.is_plain(text) is not None and not any(s in text for s in self.special)

    def _library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null is the empty text."""
        for text in texts:
            text = text or ""
            if self._simple(text):
                yield self.merger.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                yield array("I", self._library_ids(text)).tobytes()

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        """Tokens of each text: proven pre-tokens count one, only the rest is merged."""
        known, merge = self.counts_of, self.merger
        for block in text_blocks(texts):
            apart = [self.pretokens(t) if self._simple(t) else None for t in block]
            if len(known) > MEMO:
                known.clear()
                known.update(self.whole)
            for p in set().union(*[a for a in apart if a]) - known.keys():
                known[p] = len(merge.encode_ordinary(p))
            for text, parts in zip(block, apart):
                yield len(self._library_ids(text)) if parts is None else sum(map(known.__getitem__, parts))
