"""Online learning of channel weights and token boosts: a fold over searches, kept as one small JSON state."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from ..functions.text import tokens_py
from ..operators.retrieval import WEIGHTS


@dataclass
class State:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    boosts: dict[str, float] = field(default_factory=dict)
    searches: int = 0
    updates: int = 0
    version: int = 0


class Learner:
    """learn() takes the ranked rows of a search: dicts with score, content and the stage scores."""

    def __init__(self, rate: float = 0.08, floor: float = 0.05, decay: float = 0.995, gain: float = 0.04, most: float = 1.25, path: str | None = None):
        self.rate, self.floor, self.decay, self.gain, self.most, self.path = rate, floor, decay, gain, most, path
        self.state = State()
        if path and os.path.exists(path):
            with open(path) as f:
                raw = json.load(f)
            raw["boosts"] = {k: v for k, v in raw.get("boosts", {}).items() if v > 0}
            self.state = State(**raw)

    def learn(self, query: str, ranked: list[dict]) -> State:
        s = self.state
        s.searches += 1
        good = [r for r in ranked[:5] if r["score"] > 0][:3]
        shares = []
        for r in good:
            stage = {k: max(float(r.get(k) or 0.0), 0.0) for k in WEIGHTS}
            if (total := sum(stage.values())) > 0:
                shares.append((r["score"], {k: v / total for k, v in stage.items()}))
        if shares:
            mass = sum(w for w, _ in shares)
            for k in WEIGHTS:
                target = sum(w * v[k] for w, v in shares) / mass
                s.weights[k] = max((1 - self.rate) * s.weights[k] + self.rate * target, self.floor)
            total = sum(s.weights.values())
            s.weights = {k: v / total for k, v in s.weights.items()}
            s.updates += 1
        if good:
            self._boost(set(tokens_py(query, grams=False)), good)
        s.version += 1
        return s

    def _boost(self, words: set[str], good: list[dict]) -> None:
        b = self.state.boosts
        for w in words & b.keys():
            b[w] *= self.decay
        for r in good:
            for w in words & set(tokens_py(r["content"], grams=False)):
                b[w] = min(self.most, b.get(w, 0.0) + self.gain * (0.5 + max(0.0, min(r["score"], 1.0))))
        self.state.boosts = {w: v for w, v in b.items() if v >= 0.005}

    def save(self, path: str | None = None) -> None:
        with open(path or self.path, "w") as f:
            json.dump(asdict(self.state), f, ensure_ascii=False)

    def clear(self, delete_file: bool = False) -> None:
        self.state = State()
        if delete_file and self.path and os.path.exists(self.path):
            os.remove(self.path)
