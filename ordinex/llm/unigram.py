"""An existing subword vocabulary's scores as unigram log-probabilities.

A unigram model file's scores are log-probabilities already. A BPE model file's are
minus the order of its merges; Zipf's law makes a probability of that order,
p(k) ~ 1 / (k + 1), and all probabilities are made to add up to one.
"""

from __future__ import annotations

import math

SPACE = "▁"

_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and bytes with natural-log probabilities. ``index`` is the piece's id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        scores = {k: model.get_score(k) for k in kept}
        plain = [k for k in kept if not model.is_byte(k)]
        merges = all(scores[k] <= 0 and float(scores[k]).is_integer() for k in plain)
        # No merge's order reaches the number of pieces; a score beyond it marks a piece that isn't merged.
        last = max((x for k in plain if (x := -scores[k]) < model.get_piece_size()), default=0)
        # Bytes have no merge: they stand behind the last one.
        log = {k: -math.log((-scores[k] if not model.is_byte(k) else last + 1) + 1) for k in kept} if merges else scores
        total = math.log(math.fsum(math.exp(v) for v in log.values()))
        self.index: dict[str, int] = {model.id_to_piece(k): k for k in plain}
        self.bytes = {int(model.id_to_piece(k)[3:-1], 16): k for k in kept if model.is_byte(k)}
        self.size = model.get_piece_size()
        self.log_p = [0.0] * self.size
        for k, v in log.items():
            self.log_p[k] = v - total
        self.kept = kept
        self.longest = max(map(len, self.index), default=1)


def vocabulary(path: str) -> Vocabulary:
    """One for each process and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]
