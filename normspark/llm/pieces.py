"""What both unigram operators share: the piece vocabulary and how a text falls into words.

The vocabulary of a SentencePiece model gives the pieces and their scores; the segmentation with the
largest sum of scores wins. Spaces are written as U+2581 and one more stands before a text that is not
empty. Normal pieces hold that mark only at their start, so no piece crosses the start of a word and words
can be segmented on their own. The best segmentation follows the tokenizer's tie rules: ends are
improved only by a strictly larger score while starts run from left to right (the longest last piece
wins a tie), and a character that is no piece costs the smallest score less ``PENALTY``, tried after the
pieces of its start. Such a character is spelt with the byte pieces of its UTF-8 form.
"""

from __future__ import annotations

import re

MARK, PENALTY = "▁", 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[str | None] = [None] * len(model)
        self.byte = [0] * 256
        self.byte_of: dict[int, int] = {}
        scores = []
        for i in range(len(model)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece], self.id[piece], self.text[i] = model.get_score(i), i, piece
                scores.append(model.get_score(i))
        self.unknown = min(scores) - PENALTY
        self.longest = max(map(len, self.score))
        if bad := [p for p in self.score if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces cross a word's start: {bad[:3]}")


def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def words(text: str) -> list[str]:
    """The words of a text, each with the marks before it."""
    return _WORD.findall(marked(text))
