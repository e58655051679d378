"""The vocabulary of a public SentencePiece model, and its units.

Spaces stand as U+2581 and one is put in front of a text. No piece has U+2581
after another character, so neither segmentation crosses the start of a run of
spaces: texts are worked on in units, a run of spaces and what follows it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
UNIT = re.compile(" +[^ ]*")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.text_of = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")


@lru_cache(maxsize=2)
def vocabulary(file: str = MODEL) -> Vocabulary:
    if not os.path.isabs(file):
        import public_tokenizers

        file = public_tokenizers.path(file)
    return Vocabulary(file)


def units(text: str) -> list[str]:
    """The text's units, plain spaces still; empty for the empty text."""
    return UNIT.findall(" " + text) if text else []
