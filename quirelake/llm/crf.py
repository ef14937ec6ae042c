"""A linear-chain conditional random field over word shapes, in numpy.

Tokens are reduced to keys (what stands before them, and the word; digits to their count, long ones with a leading 1 apart), keys to features, and the
score of a label at a token is the sum over the eleven keys around it. As a key's scores are made once and then gathered
by number, a batch of texts costs a few array operations a token. Decoding is exact: a token whose margin for "outside"
is beyond what any path could win by transitions is outside in the best path, so Viterbi runs over the islands between
such tokens, all islands of about one length at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

OFFSETS = range(-6, 5)
_REACH = 6
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|_")
#: A token with the blanks before it: these cover a text but for the blanks at its end.
RAW = re.compile(r"\s*(?:" + TOKEN.pattern + ")")
PAD = "\0"


def key_of(raw: str, first: bool = False) -> str:
    """The key of a token with the blanks before it."""
    word = raw.lstrip()
    lead = raw[: len(raw) - len(word)]
    gap = "^" if first or "\n" in lead or "\r" in lead else " " if lead else "."
    if word[0].isdecimal():  # digits count; of long numbers the first one too
        word = ("1" if word[0] == "1" and len(word) > 8 else "9") + "9" * (min(len(word), 18) - 1)
    return gap + word


def tokenize(text: str) -> tuple[list[str], list[int], list[int]]:
    """(keys, starts, ends) of the tokens of a text. A key begins with the gap before it: none, blank or line end."""
    keys, starts, ends, at = [], [], [], 0
    for raw in RAW.findall(text):
        keys.append(key_of(raw, at == 0))
        at += len(raw)
        starts.append(at - len(raw.lstrip()))
        ends.append(at)
    return keys, starts, ends


def shape(word: str) -> str:
    if word[0].isdecimal():
        return f"9x{len(word)}"
    if not word[0].isalpha():
        return word
    if len(word) == 1:
        return "A" if word.isupper() else "a"
    return "AA" if word.isupper() else "Aa" if word[0].isupper() else "aa"


class Features:
    """Feature names of a key; the lexicon adds named groups of words (parts of names, street words, titles)."""

    def __init__(self, lexicon: dict[str, frozenset[str]], suffixes: tuple[str, ...]) -> None:
        self.lexicon, self.suffixes = lexicon, suffixes

    def of(self, key: str) -> list[str]:
        if key == PAD:
            return ["pad"]
        gap, word = key[0], key[1:]
        low = word.casefold()
        form = shape(word)
        out = ["bias", "s:" + form, "g:" + gap, f"sg:{gap}{form}", "w:" + low]
        groups = [name for name, words in self.lexicon.items() if low in words]
        out += ["l:" + g for g in groups]
        out += ["x:" + s for s in self.suffixes if len(low) > len(s) + 1 and low.endswith(s)]
        if groups and form in ("Aa", "AA"):
            out += ["lc:" + g for g in groups]
        return out


class Crf:
    def __init__(self, labels: list[str], features: Features, caution: float = 0.5) -> None:
        """caution: what is taken from the score of "outside" when decoding; proposals are checked afterwards."""
        self.labels, self.features, self.caution = labels, features, caution
        self.index: dict[str, int] = {}
        self.w = np.zeros((len(OFFSETS), 0, len(labels)), np.float32)
        self.pairs: dict[tuple[str, str], int] = {}
        self.pw = np.zeros((0, len(labels)), np.float32)
        self.trans = np.zeros((len(labels), len(labels)), np.float32)

    # ---- fitting

    def fit(self, texts: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.12, l2: float = 0.02, rare: int = 2, batch: int = 2500) -> Crf:
        """Maximum likelihood with an L2 prior, by Adam over batches of texts in turn. texts: keys and label numbers of each."""
        n_labels = len(self.labels)
        listed = {k: self.features.of(k) for k in {PAD} | {k for keys, _ in texts for k in keys}}
        count: dict[str, int] = {}
        for keys, _ in texts:
            for k in keys:
                for f in listed[k]:
                    count[f] = count.get(f, 0) + 1
        kept = {f for f, c in count.items() if c >= rare or not f.startswith("w:")} | {f for f in listed[PAD]}
        self.index = {f: i for i, f in enumerate(sorted(kept))}
        shapes = {k: shape(k[1:]) if k != PAD else PAD for k in listed}
        self.pairs = {p: i for i, p in enumerate(sorted({(shapes[x], shapes[y]) for keys, _ in texts for x, y in zip([PAD, *keys], keys)}))}
        folds = -(-len(texts) // batch)
        parts = [self._part(texts[k::folds], listed, shapes) for k in range(folds)]
        params = [np.zeros((len(OFFSETS), len(self.index), n_labels), np.float32), np.zeros((len(self.pairs), n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32)]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            part = parts[step % folds]
            grads = self._gradient(part, params)
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(params, grads, m1, m2):
                g = g / part["texts"] + l2 * p / len(texts) * 10
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        self.w, self.pw, self.trans = params
        return self

    def _part(self, texts: list[tuple[list[str], list[int]]], listed: dict[str, list[str]], shapes: dict[str, str]) -> dict:
        """A batch in arrays: keys by number, their features in both orders, and texts as rows of a grid, the longest first."""
        n_labels = len(self.labels)
        flat: list[str] = []
        spans = []
        for keys, _ in texts:
            flat += [PAD] * _REACH
            spans.append((len(flat), len(flat) + len(keys)))
            flat += keys
        flat += [PAD] * _REACH
        names = sorted(set(flat))
        number = {k: i for i, k in enumerate(names)}
        uid = np.array([number[k] for k in flat])
        at = np.concatenate([np.arange(a, b) for a, b in spans])
        gold = np.concatenate([np.array(y) for _, y in texts])
        lengths = np.array([b - a for a, b in spans])
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        width = int(lengths.max())
        grid = np.full((len(texts), width), -1, np.int64)
        for row, k in enumerate(np.argsort(-lengths, kind="stable")):
            grid[row, : lengths[k]] = first[k] + np.arange(lengths[k])
        gold_trans = np.zeros((n_labels, n_labels), np.float32)
        inner = np.ones(len(at) - 1, bool)
        inner[first[1:] - 1] = False
        np.add.at(gold_trans, (gold[:-1][inner], gold[1:][inner]), 1)
        one_hot = np.zeros((len(at), n_labels), np.float32)
        one_hot[np.arange(len(at)), gold] = 1
        keys_of = np.array([k for k, name in enumerate(names) for f in listed[name] if f in self.index])
        features_of = np.array([self.index[f] for name in names for f in listed[name] if f in self.index])
        order = np.argsort(features_of, kind="stable")
        used, feature_starts = np.unique(features_of[order], return_index=True)
        return {
            "texts": len(texts), "names": len(names), "one_hot": one_hot, "gold_trans": gold_trans, "grid": grid, "live": (grid >= 0).sum(0).tolist(), "keys_at": [uid[at + off] for off in OFFSETS],
            "pairs_at": np.array([self.pairs.get((shapes[flat[i - 1]], shapes[flat[i]]), 0) for i in at.tolist()]), "features_of": features_of, "key_starts": np.searchsorted(keys_of, np.arange(len(names))),
            "keys_by_feature": keys_of[order], "used": used, "feature_starts": feature_starts,
        }

    def _gradient(self, part: dict, params: list[np.ndarray]) -> list[np.ndarray]:
        n_labels, n_offsets = len(self.labels), len(OFFSETS)
        weights = np.ascontiguousarray(params[0].transpose(1, 0, 2)).reshape(len(self.index), -1)
        z = np.add.reduceat(weights[part["features_of"]], part["key_starts"], axis=0).reshape(part["names"], n_offsets, n_labels)
        e = params[1][part["pairs_at"]].copy()
        for o, keys in enumerate(part["keys_at"]):
            e += z[keys, o]
        marginals, expected = self._marginals(e, params[2], part["grid"], part["live"])
        d = marginals - part["one_hot"]
        dz = np.zeros((part["names"], n_offsets, n_labels), np.float32)
        for label in range(n_labels):
            column = np.ascontiguousarray(d[:, label])
            for o, keys in enumerate(part["keys_at"]):
                dz[:, o, label] = np.bincount(keys, column, part["names"])
        dw = np.zeros((len(self.index), n_offsets * n_labels), np.float32)
        dw[part["used"]] = np.add.reduceat(dz.reshape(part["names"], -1)[part["keys_by_feature"]], part["feature_starts"], axis=0)
        dp = np.stack([np.bincount(part["pairs_at"], d[:, label], len(self.pairs)) for label in range(n_labels)], 1).astype(np.float32)
        return [dw.reshape(len(self.index), n_offsets, n_labels).transpose(1, 0, 2), dp, expected - part["gold_trans"]]

    @staticmethod
    def _marginals(e: np.ndarray, trans: np.ndarray, grid: np.ndarray, live: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals of all tokens and the expected transitions, by scaled forward and backward passes."""
        x = np.exp(e - e.max(1, keepdims=True))
        a = np.exp(trans)
        n, width = grid.shape
        labels = e.shape[1]
        alpha = np.zeros((width, n, labels), np.float32)
        emit = np.ones((width, n, labels), np.float32)
        for t in range(width):
            k = live[t]
            emit[t, :k] = x[grid[:k, t]]
            now = emit[t, :k] * (alpha[t - 1, :k] @ a if t else 1.0)
            alpha[t, :k] = now / now.sum(1, keepdims=True)
        beta = np.ones((n, labels), np.float32)
        out = np.zeros_like(e)
        expected = np.zeros((labels, labels), np.float64)
        for t in range(width - 1, -1, -1):
            k = live[t]
            post = alpha[t, :k] * beta[:k]
            out[grid[:k, t]] = post / post.sum(1, keepdims=True)
            if t:
                back = emit[t, :k] * beta[:k]
                joint = alpha[t - 1, :k].T @ (back / np.maximum((alpha[t - 1, :k] @ a * back).sum(1, keepdims=True), 1e-30))
                expected += joint * a
                new = back @ a.T
                beta[:k] = new / new.sum(1, keepdims=True)
        return out, expected.astype(np.float32)

    # ---- decoding

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Decodes batches of texts; keeps the scores of the keys it has seen."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        self.number: dict[str, int] = {}
        self.raw_number: dict[str, int] = {}
        self.shape_number: dict[str, int] = {s: i for i, s in enumerate(sorted({s for p in crf.pairs for s in p}))}
        s = len(self.shape_number) + 1
        self.unknown_shape = s - 1
        self.pair_scores = np.zeros((s * s, len(crf.labels)), np.float32)
        for (a, b), i in crf.pairs.items():
            self.pair_scores[self.shape_number[a] * s + self.shape_number[b]] = crf.pw[i]
        self.size = s
        self.rows = np.zeros((1024, len(OFFSETS), len(crf.labels)), np.float32)
        self.shapes = np.zeros(1024, np.int64)
        self.margin = 2 * float(crf.trans.max() - crf.trans.min()) + 1e-3

    def _add(self, key: str) -> int:
        k = len(self.number)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        ids = [self.crf.index[f] for f in self.crf.features.of(key) if f in self.crf.index]
        self.rows[k] = self.crf.w[:, ids].sum(1)
        self.shapes[k] = self.shape_number.get(shape(key[1:]) if key != PAD else PAD, self.unknown_shape)
        self.number[key] = k
        return k

    def codes(self, raws: list[str]) -> list[int]:
        """The numbers of the keys of a text's tokens; each spelling is looked at once."""
        get = self.raw_number.get
        out = [get(r) for r in raws]
        for i in [i for i, c in enumerate(out) if c is None]:
            key = key_of(raws[i])
            code = self.number.get(key)
            out[i] = self.raw_number[raws[i]] = self._add(key) if code is None else code
        if raws:
            key = key_of(raws[0], True)
            out[0] = self.number[key] if key in self.number else self._add(key)
        return out

    def label(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """The labels of each text's tokens on the best path; texts are lists of tokens with the blanks before them."""
        if len(self.number) > 200_000 or len(self.raw_number) > 400_000:
            self.number.clear()
            self.raw_number.clear()
        pad = self.number.get(PAD)
        if pad is None:
            pad = self._add(PAD)
        uid: list[int] = [pad] * _REACH
        bounds = []
        for raws in texts:
            a = len(uid)
            uid += self.codes(raws)
            bounds.append((a, len(uid)))
            uid += [pad] * _REACH
        u = np.array(uid)
        n = len(u)
        e = np.zeros((n, len(self.crf.labels)), np.float32)
        for o, off in enumerate(OFFSETS):
            lo, hi = max(0, -off), min(n, n - off)
            e[lo:hi] += self.rows[u[lo + off : hi + off], o]
        s = self.shapes[u]
        e[1:] += self.pair_scores[s[:-1] * self.size + s[1:]]
        e[:, 0] -= self.crf.caution
        out = np.zeros(n, np.int8)
        sure = e[:, 0] - e[:, 1:].max(1) > self.margin
        sure[u == pad] = True
        self._islands(e, sure, out)
        return [out[a:b] for a, b in bounds]

    def _islands(self, e: np.ndarray, sure: np.ndarray, out: np.ndarray) -> None:
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return
        breaks = np.flatnonzero(np.diff(open_) > 1)
        starts = open_[np.concatenate([[0], breaks + 1])]
        stops = open_[np.concatenate([breaks, [len(open_) - 1]])] + 1
        lengths = stops - starts
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            longest = max(8, int(lengths[order[i]] * 1.5))
            j = i
            while j < len(order) and lengths[order[j]] <= longest and (j - i) * longest < 200_000:
                j += 1
            part = order[i : max(j, i + 1)]
            self._viterbi(e, starts[part], lengths[part], out)
            i = max(j, i + 1)

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
        """Best paths of islands, each between two tokens that are outside."""
        trans = self.crf.trans
        width, n, labels = int(lengths.max()), len(starts), trans.shape[0]
        best = e[starts] + trans[0]
        back = np.zeros((width, n, labels), np.int8)
        final = np.where((lengths == 1)[:, None], best, 0)
        for t in range(1, width):
            alive = lengths > t
            through = best[:, :, None] + trans
            back[t] = through.argmax(1)
            step = through.max(1) + e[np.minimum(starts + t, len(e) - 1)]
            best = np.where(alive[:, None], step, best)
            ends = lengths == t + 1
            final[ends] = best[ends]
        state = (final + trans[:, 0]).argmax(1)
        for t in range(width - 1, -1, -1):
            here = lengths > t
            out[(starts + t)[here]] = state[here]
            if t:
                state = np.where(here, back[t][np.arange(n), state], state)
