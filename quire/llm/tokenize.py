"""Token ids and counts of whole texts, exactly as the tokenizer library gives them.

Byte-level ids (``ByteEncoder``) come from tiktoken, which holds the same vocabulary as ranks and gives the same ids in
a fifth of the time; texts with special strings, or with runs so long that tiktoken's merging would take the square of
their length, go to the tokenizer library itself.

For counts (``PieceCounter``): a tokenizer of the word kind never lets a token cross the place where a run of ASCII white space begins, so a text is
cut there and each piece is looked up in the worker's memory; only pieces not met before are encoded.  Texts in which
that does not hold (special strings, other white space next to the cut) go whole to the library.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a worker remembers, and the longest piece it remembers; beyond that it encodes again.
MEMO_PIECES = 600_000
MEMO_CHARS = 48
LONG_RUN = 2000

_NO_SPACE = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: White space beyond ASCII, and the separators 1C to 1F.
_OTHER_SPACE = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                                 0x3000]))
_WHOLE = re.compile(rf"<\||[{_OTHER_SPACE}]")
_LOADED: dict[tuple, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_digest(path: str) -> str:
    """Identifies the tokenizer's version: SHA-256 of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ByteEncoder:
    """Ids of whole texts as little-endian 32-bit bytes, with a byte-level vocabulary that is there as ranks too."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(tokenizer_path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join([re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
                                           + [rf"\S{{{LONG_RUN}}}", rf"\s{{{LONG_RUN}}}"])).search

    def values(self, texts: list[str]) -> list[bytes]:
        plain, special = self.ranks.encode_ordinary, self.special
        out: list = [None if special(t) else array("I", plain(t)).tobytes() for t in texts]
        rest = [i for i, v in enumerate(out) if v is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", x.ids).tobytes()
        return out


class PieceCounter:
    """Token counts with a tokenizer that drops white space."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def values(self, texts: list[str]) -> list[int]:
        """Token count of each whole text."""
        result: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if _WHOLE.search(t)]
        for i, v in zip(whole, self.count([texts[i] for i in whole]) if whole else []):
            result[i] = v
        rest = [i for i in range(len(texts)) if result[i] is None]
        pieces = [_NO_SPACE.findall(texts[i]) for i in rest]
        memo = self.memo
        new = list({p for ps in pieces for p in ps if p not in memo})
        if len(memo) + len(new) > MEMO_PIECES:
            memo.clear()
            new = list({p for ps in pieces for p in ps})
        for k in range(0, len(new), 20_000):
            memo.update(zip(new[k:k + 20_000], self.count(new[k:k + 20_000])))
        for i, ps in zip(rest, pieces):
            result[i] = sum(map(memo.__getitem__, ps))
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return result


def encoder(kind: type, name: str):
    """One encoder per worker process."""
    if (kind, name) not in _LOADED:
        _LOADED[kind, name] = kind(name)
    return _LOADED[kind, name]
