"""Tokenizers by file, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

#: Above this many characters without a break the heap-based encoder is used.
LONG_RUN = 2000


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE file: the ids of ``tokenizers`` with add_special_tokens=False.

    Where the folder also holds the vocabulary as ranks (same name, ``.tiktoken``), that
    file and its quicker library do the work; both are compared on load and texts with
    very long unbroken runs, or that the quicker one refuses, go to ``tokenizers``.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_file(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    ranked = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranked):
        return by_file
    import public_tokenizers
    import regex
    import tiktoken

    with open(ranked, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    run = regex.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))
    probes = (
        "It's 12 o'clock,\n\n  naïve   ÉTÉ!!  \t ünï 漢字 🙂 <|endoftext|> x", "", " ", "\n \n", "a" * 300, "0123456789" * 9, "x  y\r\n\tz ", "'LL we'Ve ſ\u0130\u00df", "e\u0301 \u200d👩\u200d👩\u200d👧 \ufeff\u2028\u3000.",
        "".join(map(chr, range(32, 0x600, 7))), "<|endoftext|><|endoftext", "if (a[0] != null) { return \"b\\n\"; } // ==> ",
    )
    if any(quick.encode(p, allowed_special="all") != by_file(p) for p in probes):
        return by_file

    def by_ranks(text: str) -> list[int]:
        if len(text) >= LONG_RUN and run.search(text):
            return by_file(text)
        try:
            return quick.encode(text, allowed_special="all")
        except ValueError:  # the quicker library gives up on some inputs; the other one is the definition
            return by_file(text)

    return by_ranks
