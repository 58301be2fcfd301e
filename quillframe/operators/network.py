"""A small decoder network in NumPy, run over Arrow batches: n-gram memory, gated attention, Hadamard layers, lane mixing.

One function, :meth:`Network.advance`, takes the next tokens of a sequence with the state so far; a whole sequence is the same
call with an empty state, so decoding step by step and scoring at once agree by construction up to rounding.
:meth:`Network.continuations` decodes many sequences together and leaves out what no logits asked for depend on: the last
layer but for its keys and values where nothing is decoded, and what depends on a token alone once for each of the vocabulary.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillframe.functions.vectors import hadamard_mlp, sinkhorn, walsh

PAD, EOS, BOS = 0, 1, 2
TAPS = 4
STEP = 256
#: Tokens whose keys and values are held at once (a longer sequence is alone), tokens taken through the layers at once, and queries scored at once.
HELD, TOGETHER, QUERIES = 1 << 15, 1 << 9, 32


@dataclass(frozen=True)
class Config:
    vocab: int = 256
    width: int = 64
    heads: int = 4
    kv_heads: int = 2
    layers: int = 2
    lanes: int = 2
    orders: tuple[int, ...] = (2, 3)
    slots: int = 64
    memory_layers: tuple[int, ...] = (1,)
    longest: int = 256
    window: int = 0
    theta: float = 10000.0

    @classmethod
    def of(cls, **given) -> Config:
        """Keys that aren't known are left out."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: x for k, x in given.items() if k in known})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-6)


def norm(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (1 + scale) * unit(x)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def init(c: Config, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded parameters by name."""
    rng = np.random.default_rng(seed)
    full = 1 << (c.width - 1).bit_length()
    kv, wide = c.width // c.heads * c.kv_heads, c.lanes * c.width

    def normal(*shape: int) -> np.ndarray:
        return rng.standard_normal(shape) / math.sqrt(shape[-2])

    p: dict[str, np.ndarray] = {"embedding": 0.02 * rng.standard_normal((c.vocab, c.width)), "final_norm": np.zeros(c.width)}
    for n in range(c.layers):
        at = f"layer{n}."
        p |= {at + "q": normal(c.width, c.width), at + "k": normal(c.width, kv), at + "v": normal(c.width, kv), at + "gate": normal(c.width, c.width), at + "out": normal(c.width, c.width) / math.sqrt(2 * c.layers)}
        p |= {at + x: np.zeros(c.width) for x in ("norm_in", "norm_post", "norm_hada")} | {at + x: np.zeros(c.width // c.heads) for x in ("norm_q", "norm_k")}
        p |= {at + "attn_gate": np.zeros(()), at + "d1": np.ones(full), at + "d2": np.ones(full), at + "d3": np.full(full, 0.02)}
        p |= {at + "phi_pre": normal(wide, c.lanes), at + "phi_post": normal(wide, c.lanes), at + "phi_res": normal(wide, c.lanes**2), at + "b_res": 4.0 * np.eye(c.lanes)}
    sub = c.width // len(c.orders)
    for s in range(len(c.memory_layers)):
        at = f"memory{s}."
        taps = np.zeros((TAPS, c.width))
        taps[0] = 1
        p |= {at + "tables": rng.standard_normal((len(c.orders), c.slots, sub)) / math.sqrt(c.slots), at + "key": normal(sub * len(c.orders), c.width), at + "value": normal(sub * len(c.orders), c.width), at + "taps": taps}
    p |= {"contrast.probes": normal(4, c.width), "contrast.proj": normal(4 * c.width, 32), "confidence.probes": normal(8, c.width), "confidence.proj": normal(8 * c.width, 1), "confidence.bias": np.zeros(1)}
    return p


def ngram_slots(tokens: np.ndarray, orders: tuple[int, ...], slots: int) -> np.ndarray:
    """(position, order) slots in 32-bit arithmetic; tokens before the first are 0."""
    u, out = tokens.astype(np.uint64), []
    low = np.uint64(0xFFFFFFFF)
    for n, order in enumerate(orders):
        acc = np.full_like(u, (0x9E3779B9 * (n + 1)) & 0xFFFFFFFF)
        for j in range(order):
            back = np.concatenate((np.zeros(min(j, len(u)), np.uint64), u[: max(0, len(u) - j)]))
            acc = ((acc ^ back) * np.uint64(0x01000193)) & low
        out.append((acc ^ (acc >> np.uint64(15))) % np.uint64(slots))
    return np.stack(out, 1).astype(np.int64)


@dataclass
class State:
    """Tokens so far and each layer's keys and values."""

    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)


class Held:
    """Keys and values of one sequence by layer, with room for all that will come; values end with a one, which sums the weights."""

    def __init__(self, c: Config, prompt: np.ndarray, room: int) -> None:
        self.tokens, self.n, size = np.concatenate((prompt, np.zeros(max(0, room - len(prompt)), np.int64))), 0, c.width // c.heads
        self.keys = np.empty((c.layers, c.kv_heads, room, size))
        self.values = np.ones((c.layers, c.kv_heads, room, size + 1))


class Network:
    def __init__(self, config: Config, params: dict[str, np.ndarray]) -> None:
        self.c, self.p = config, params

    def __getstate__(self) -> dict:
        return {"c": self.c, "p": self.p}

    def _rope(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        half = x.shape[-1] // 2
        angle = at[:, None] / self.c.theta ** (np.arange(half) * 2 / x.shape[-1])
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        a, b = x[..., :half], x[..., half:]
        return np.concatenate((a * cos - b * sin, b * cos + a * sin), -1)

    def _memory(self, site: int, tokens: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, values) of the n-gram memory at the positions from first on, from a bounded look-back."""
        c, p, at = self.c, self.p, f"memory{site}."
        reach = max(c.orders)
        start = max(0, first - (TAPS - 1) * reach - reach)
        slots = ngram_slots(tokens[start:], c.orders, c.slots)
        if start:  # n-grams that begin before the look-back are wrong there, and no position from first on needs them
            slots = slots[reach:]
            start += reach
        where = np.arange(start, start + len(slots))
        found = np.stack([p[at + "tables"][n, slots[:, n]] * (where >= order - 1)[:, None] for n, order in enumerate(c.orders)], 1).reshape(len(slots), -1)
        value = found @ p[at + "value"]
        out = np.zeros_like(value)
        for j in range(TAPS):
            k = j * reach
            if k < len(value):
                out[k:] += p[at + "taps"][j] * value[: len(value) - k]
        return (found @ p[at + "key"])[first - start :], out[first - start :]

    def _attention(self, n: int, x: np.ndarray, state: State, first: int) -> np.ndarray:
        c, p, at = self.c, self.p, f"layer{n}."
        size, group = c.width // c.heads, c.heads // c.kv_heads
        place = np.arange(first, first + len(x))
        q = self._rope(norm((x @ p[at + "q"]).reshape(len(x), c.heads, size), p[at + "norm_q"]), place)
        k = self._rope(norm((x @ p[at + "k"]).reshape(len(x), c.kv_heads, size), p[at + "norm_k"]), place)
        v = (x @ p[at + "v"]).reshape(len(x), c.kv_heads, size)
        if first:
            k, v = np.concatenate((state.keys[n], k)), np.concatenate((state.values[n], v))
        state.keys[n : n + 1], state.values[n : n + 1] = [k], [v]
        far = place[:, None] - np.arange(len(k))[None]
        seen = (far >= 0) & ((far < c.window) if c.window else True)
        score = np.einsum("qhd,khd->hqk", q, np.repeat(k, group, 1)) / math.sqrt(size)
        mixed = np.einsum("hqk,khd->qhd", softmax(np.where(seen, score, -1e30)), np.repeat(v, group, 1)).reshape(len(x), -1)
        return (mixed * sigmoid(x @ p[at + "gate"])) @ p[at + "out"]

    def advance(self, state: State, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, cells) of the next tokens; cells (token, layer + 1, width) are the embedding and every layer's mean lane."""
        c, p, first = self.c, self.p, len(state.tokens)
        tokens = np.asarray(tokens, np.int64)
        state.tokens = np.concatenate((state.tokens, tokens))
        state.keys, state.values = state.keys or [np.zeros(0)] * c.layers, state.values or [np.zeros(0)] * c.layers
        x0 = p["embedding"][tokens] * math.sqrt(c.width)
        lanes, cells = np.repeat(x0[:, None], c.lanes, 1), [x0]
        for n in range(c.layers):
            at, lane = f"layer{n}.", np.eye(c.lanes)[n % c.lanes]
            flat = unit(lanes.reshape(len(tokens), -1))
            u = np.einsum("tn,tnc->tc", sigmoid(0.01 * (flat @ p[at + "phi_pre"]) + 8 * lane - 4), lanes)
            y = u
            for site, layer in enumerate(c.memory_layers):
                if layer == n:
                    mk, mv = self._memory(site, state.tokens, first)
                    y = y + sigmoid((unit(y) * unit(mk)).sum(-1, keepdims=True) / math.sqrt(c.width)) * mv
            y = y + sigmoid(p[at + "attn_gate"]) * norm(self._attention(n, norm(y, p[at + "norm_in"]), state, first), p[at + "norm_post"])
            y = y + hadamard_mlp(norm(y, p[at + "norm_hada"]), p[at + "d1"], p[at + "d2"], p[at + "d3"])
            post = 2 * sigmoid(0.01 * (flat @ p[at + "phi_post"]) - 4 * (1 - lane))
            mix = sinkhorn(0.01 * (flat @ p[at + "phi_res"]).reshape(-1, c.lanes, c.lanes) + p[at + "b_res"])
            lanes = np.einsum("tij,tjc->tic", mix, lanes) + post[..., None] * (y - u)[:, None]
            cells.append(lanes.mean(1))
        return norm(lanes.mean(1), p["final_norm"]) @ p["embedding"].T, np.stack(cells, 1)

    def logits(self, tokens: np.ndarray) -> np.ndarray:
        return self.advance(State(), tokens)[0]

    def pooled(self, tokens: np.ndarray, head: str) -> np.ndarray:
        """Attention pooling of all cells of tokens that aren't padding by a head's probes."""
        tokens = np.asarray(tokens)
        cells = self.advance(State(), tokens)[1][tokens != PAD].reshape(-1, self.c.width)
        weight = softmax(self.p[head + ".probes"] @ cells.T / math.sqrt(self.c.width))
        return (weight @ cells).reshape(-1)

    def embed(self, tokens: np.ndarray) -> np.ndarray:
        """Unit vector for similarity."""
        x = self.pooled(tokens, "contrast") @ self.p["contrast.proj"]
        return x / math.sqrt(float(x @ x) + 1e-12)

    def confidence(self, tokens: np.ndarray) -> float:
        return float(sigmoid(self.pooled(tokens, "confidence") @ self.p["confidence.proj"] + self.p["confidence.bias"])[0])

    def stream(self, prompt: list[int], most: int, temperature: float = 0.0, seed: int = 0) -> Iterator[tuple[int, float, float]]:
        """(token, probability, entropy) one after the other, until the end token, the length or the longest sequence."""
        rng, state, count = np.random.default_rng(seed), State(), 0
        prompt = ([BOS] + list(prompt))[: self.c.longest - 1]
        for at in range(0, len(prompt), STEP):  # scores of a part against all before it, never of a whole long prompt
            step = self.advance(state, np.array(prompt[at : at + STEP]))[0][-1]
        while count < most and len(state.tokens) < self.c.longest:
            p = softmax(step)
            token = int(p.argmax()) if temperature <= 0 else int((step / temperature + rng.gumbel(size=len(step))).argmax())
            if token == EOS:
                break
            yield token, float(p[token] if temperature > 0 else p.max()), float(-(p * np.log(np.maximum(p, 1e-300))).sum())
            count += 1
            if count < most:
                step = self.advance(state, np.array([token]))[0][-1]

    def generate(self, prompt: list[int], most: int, temperature: float = 0.0, seed: int = 0) -> dict:
        """The tokens of :meth:`stream`, the logarithms of their probabilities, and the signals of the whole."""
        steps = list(self.stream(prompt, most, temperature, seed))
        out, probs, entropies = ([s[i] for s in steps] for i in range(3))
        return _signals(out, probs, entropies)

    @cached_property
    def _first(self) -> dict[str, np.ndarray]:
        """What the first layer makes of each token of the vocabulary, wherever it stands."""
        c, p = self.c, self.p
        x0 = p["embedding"] * math.sqrt(c.width)
        lanes = np.repeat(x0[:, None], c.lanes, 1)
        pre, post, mix = self._lane_weights(0, lanes, True)
        own = {"u": (u := np.einsum("tn,tnc->tc", pre, lanes)), "post": post, "mixed": mix @ lanes}
        return own if 0 in c.memory_layers else own | dict(zip(("q", "k", "v", "gate"), self._projected(0, u, True)))

    @cached_property
    def _memories(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, values) that each slot of each order adds, by site."""
        found = []
        for site in range(len(self.c.memory_layers)):
            at, sub = f"memory{site}.", self.p[f"memory{site}.tables"].shape[-1]
            parts = [[self.p[at + "tables"][n] @ self.p[at + x][n * sub : (n + 1) * sub] for n in range(len(self.c.orders))] for x in ("key", "value")]
            found.append((np.stack(parts[0]), np.stack(parts[1])))
        return found

    @cached_property
    def _dense(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each layer's diagonals and Walsh transforms as two matrices."""
        found = []
        for n in range(self.c.layers):
            d1, d2, d3 = (self.p[f"layer{n}.{x}"] for x in ("d1", "d2", "d3"))
            h = walsh(np.eye(len(d1)))
            found.append(((d1[:, None] * h * d2)[: self.c.width], (h * d3)[:, : self.c.width]))
        return found

    def _lane_weights(self, n: int, lanes: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """(pre, post, mix) of a layer; the last two only for the whole of it."""
        c, at, lane = self.c, f"layer{n}.", np.eye(self.c.lanes)[n % self.c.lanes]
        flat = unit(lanes.reshape(len(lanes), -1))
        pre = sigmoid(0.01 * (flat @ self.p[at + "phi_pre"]) + 8 * lane - 4)
        if not whole:
            return pre, None, None
        mix = sinkhorn(0.01 * (flat @ self.p[at + "phi_res"]).reshape(-1, c.lanes, c.lanes) + self.p[at + "b_res"])
        return pre, 2 * sigmoid(0.01 * (flat @ self.p[at + "phi_post"]) - 4 * (1 - lane)), mix

    def _projected(self, n: int, y: np.ndarray, whole: bool) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray | None]:
        """(q, k, v, gate) before rotation, q over the root of its size; the halves that rotate are one complex number, and q and gate only for the whole."""
        c, p, at = self.c, self.p, f"layer{n}."
        size = c.width // c.heads
        x = norm(y, p[at + "norm_in"])

        def turned(name: str, heads: int) -> np.ndarray:
            found = norm((x @ p[at + name]).reshape(len(x), heads, size), p[at + "norm_" + name])
            return found[..., : size // 2] + 1j * found[..., size // 2 :]

        k, v = turned("k", c.kv_heads), (x @ p[at + "v"]).reshape(len(x), c.kv_heads, size)
        return (turned("q", c.heads) / math.sqrt(size), k, v, sigmoid(x @ p[at + "gate"])) if whole else (None, k, v, None)

    def _recalled(self, site: int, held: list[Held], parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What _memory gives, for the parts of many sequences one after the other."""
        c, reach = self.c, max(self.c.orders)
        back = TAPS * reach
        tokens = np.concatenate([np.r_[np.zeros(max(0, back - a), np.int64), x.tokens[max(0, a - back) : b]] for x, (a, b) in zip(held, parts)])
        where = np.concatenate([np.arange(a - back, b) for a, b in parts])
        real = np.flatnonzero(np.concatenate([np.arange(a - back, b) >= a for a, b in parts]))
        slots = ngram_slots(tokens, c.orders, c.slots)
        keys, values = self._memories[site]
        key, value = 0.0, 0.0
        for n, order in enumerate(c.orders):
            there = where >= order - 1
            key = key + keys[n][slots[real, n]] * there[real, None]
            value = value + values[n][slots[:, n]] * there[:, None]
        taps = self.p[f"memory{site}.taps"]
        return key, sum(taps[j] * value[real - j * reach] for j in range(TAPS) if j == 0 or taps[j].any())

    def _attended(self, n: int, q: np.ndarray, held: Held, first: int) -> np.ndarray:
        """The values mixed for queries (heads, position, size) that stand from first on."""
        c, group, out = self.c, self.c.heads // self.c.kv_heads, np.empty(q.shape)
        at = f"layer{n}.norm_"  # units of that many numbers bound every score
        steep = math.sqrt(q.shape[-1]) * np.abs(1 + self.p[at + "q"]).max() * np.abs(1 + self.p[at + "k"]).max() > 500
        room = np.empty(group * min(q.shape[1], QUERIES) * (first + q.shape[1]))
        for low in range(0, q.shape[1], QUERIES):
            high = min(q.shape[1], low + QUERIES)
            end, begin = first + high, max(0, first + low - c.window + 1) if c.window else 0
            far = np.arange(first + low, end)[:, None] - np.arange(begin if c.window else first + low, end)
            hidden = np.where((far < 0) | (far >= c.window) if c.window else far < 0, -np.inf, 0.0)
            for g in range(c.kv_heads):
                own = slice(g * group, (g + 1) * group)
                own_q = q[own, low:high].reshape(-1, q.shape[-1])
                score = np.matmul(own_q, held.keys[n, g, begin:end].T, out=room[: len(own_q) * (end - begin)].reshape(len(own_q), -1))
                if high - low > 1 or c.window:
                    score.reshape(group, high - low, -1)[:, :, -hidden.shape[1] :] += hidden
                if steep:
                    score -= score.max(-1, keepdims=True)
                np.exp(score, out=score)
                mixed = score @ held.values[n, g, begin:end]
                out[own, low:high] = (mixed[:, :-1] / mixed[:, -1:]).reshape(group, high - low, -1)
        return out

    def _extend(self, held: list[Held], ends: list[int], logits: bool) -> np.ndarray | None:
        """Take the tokens of many sequences up to their ends; logits of all of those if asked for."""
        c, p = self.c, self.p
        size, parts = c.width // c.heads, [(x.n, end) for x, end in zip(held, ends)]
        cuts = np.r_[0, np.cumsum([b - a for a, b in parts])].tolist()
        tokens, place = np.concatenate([x.tokens[a:b] for x, (a, b) in zip(held, parts)]), np.concatenate([np.arange(a, b) for a, b in parts])
        turn = np.exp(1j * (place[:, None] / c.theta ** (np.arange(size // 2) * 2 / size)))[:, None]
        lanes = None
        for n in range(c.layers):
            at, whole = f"layer{n}.", logits or n < c.layers - 1
            if n:
                pre, post, mix = self._lane_weights(n, lanes, whole)
                u = np.einsum("tn,tnc->tc", pre, lanes)
            else:
                u = self._first["u"][tokens]
            y = u
            for site, layer in enumerate(c.memory_layers):
                if layer == n:
                    mk, mv = self._recalled(site, held, parts)
                    y = y + sigmoid((unit(y) * unit(mk)).sum(-1, keepdims=True) / math.sqrt(c.width)) * mv
            if n or 0 in c.memory_layers:
                q, k, v, gate = self._projected(n, y, whole)
            else:
                q, k, v, gate = (self._first[x][tokens] for x in ("q", "k", "v", "gate"))
            k = (k * turn).view(np.float64)
            for x, (a, b), low, high in zip(held, parts, cuts, cuts[1:]):
                x.keys[n, :, a:b], x.values[n, :, a:b, :-1] = k[low:high].transpose(1, 0, 2), v[low:high].transpose(1, 0, 2)
            if not whole:
                break
            q = np.ascontiguousarray((q * turn).view(np.float64).transpose(1, 0, 2))
            mixed = np.concatenate([self._attended(n, q[:, low:high], x, a) for x, (a, _), low, high in zip(held, parts, cuts, cuts[1:])], 1)
            mixed = mixed.transpose(1, 0, 2).reshape(len(tokens), -1)
            y = y + sigmoid(p[at + "attn_gate"]) * norm((mixed * gate) @ p[at + "out"], p[at + "norm_post"])
            one, two = self._dense[n]
            z = norm(y, p[at + "norm_hada"]) @ one
            z /= 1 + np.exp(-z)
            y = y + z @ two
            if n:
                lanes = mix @ lanes + post[..., None] * (y - u)[:, None]
            else:
                lanes = self._first["mixed"][tokens] + self._first["post"][tokens][..., None] * (y - u)[:, None]
        for x, end in zip(held, ends):
            x.n = end
        return norm(lanes.mean(1), p["final_norm"]) @ p["embedding"].T if logits else None

    def _continued(self, prompts: list[np.ndarray], most: int, temperature: float, seed: int) -> list[dict]:
        held = [Held(self.c, x, min(self.c.longest, len(x) + most)) for x in prompts]
        together: list[tuple[Held, int]] = []
        for x, prompt in zip(held, prompts):  # all but the last token of each, which is the first step's
            for end in [*range(TOGETHER, len(prompt) - 1, TOGETHER), len(prompt) - 1]:
                if together and (together[-1][0] is x or sum(e - h.n for h, e in together) + end % TOGETHER > TOGETHER):
                    self._extend(*map(list, zip(*together)), False)
                    together = []
                if end > x.n:
                    together.append((x, end))
        if together:
            self._extend(*map(list, zip(*together)), False)
        draws = [np.random.default_rng(seed) for _ in held] if temperature > 0 else []
        found: list[tuple[list, list, list]] = [([], [], []) for _ in held]
        open_ = list(range(len(held)))
        for _ in range(most):
            open_ = [i for i in open_ if held[i].n + 1 < self.c.longest]
            if not open_:
                break
            steps = self._extend([held[i] for i in open_], [held[i].n + 1 for i in open_], True)
            p = softmax(steps)
            entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(-1)
            best = p.argmax(-1)
            if temperature > 0:
                best = np.array([int((step / temperature + draws[i].gumbel(size=len(step))).argmax()) for i, step in zip(open_, steps)])
            for i, token, prob, e in zip(open_, best.tolist(), p[np.arange(len(best)), best].tolist(), entropy.tolist()):
                if token != EOS:
                    for part, x in zip(found[i], (token, prob, e)):
                        part.append(x)
                    if held[i].n < len(held[i].tokens):
                        held[i].tokens[held[i].n] = token
            open_ = [i for i, token in zip(open_, best.tolist()) if token != EOS]
        return [_signals(*x) for x in found]

    def continuations(self, prompts: list, most: int, temperature: float = 0.0, seed: int = 0) -> Iterator[dict]:
        """What :meth:`generate` gives for each prompt, up to rounding; as many are decoded together as HELD has room for."""
        some: list[np.ndarray] = []
        for prompt in prompts:
            prompt = np.concatenate(([BOS], np.asarray(prompt, np.int64)))[: self.c.longest - 1].astype(np.int64)
            if some and sum(map(len, some)) + len(prompt) > HELD:
                yield from self._continued(some, most, temperature, seed)
                some = []
            some.append(prompt)
        if some:
            yield from self._continued(some, most, temperature, seed)


def _signals(tokens: list[int], probs: list[float], entropies: list[float]) -> dict:
    logs = float(np.log(np.clip(probs, 1e-12, 1)).mean()) if probs else -math.inf
    return {"tokens": tokens, "logprobs": [math.log(max(x, 1e-12)) for x in probs], "min_prob": min(probs, default=0.0), "mean_logprob": logs, "max_entropy": max(entropies, default=0.0)}


def generate(df: DataFrame, prompt: str, network: Network, most: int = 96, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """df with tokens, logprobs, min_prob, mean_logprob and max_entropy of what follows a column of prompt ids; parameters are broadcast.

    Prompts of a batch may be of any lengths: each is its own sequence, so nothing is padded. A row's draws depend on seed alone.
    """
    shared = df.sparkSession.sparkContext.broadcast(network)
    extra = [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("logprobs", T.ArrayType(T.DoubleType()))] + [T.StructField(n, T.DoubleType()) for n in ("min_prob", "mean_logprob", "max_entropy")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = (x.values.to_numpy() if x.is_valid else [] for x in batch.column(prompt))
            found = list(shared.value.continuations(prompts, most, temperature, seed))
            new = [pa.array([f["tokens"] for f in found], pa.list_(pa.int32())), pa.array([f["logprobs"] for f in found], pa.list_(pa.float64()))]
            new += [pa.array([f[e.name] for f in found], pa.float64()) for e in extra[2:]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[e.name for e in extra]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def embed(df: DataFrame, ids: str, network: Network, out: str = "vector") -> DataFrame:
    """df with the unit vector of a column of token ids."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [shared.value.embed(np.array(x)).tolist() if x else None for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def average(networks: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The element-wise mean of checkpoints, in half precision."""
    return {k: np.mean([n[k].astype(np.float32) for n in networks], 0).astype(np.float16) for k in networks[0]}


def low_rank(params: dict[str, np.ndarray], names: list[str], rank: int, seed: int = 0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(A, B) for each matrix: A small and random, B zero, so that merging changes nothing at first."""
    rng = np.random.default_rng(seed)
    return {n: (rng.standard_normal((params[n].shape[0], rank)) / rank, np.zeros((rank, params[n].shape[1]))) for n in names}


def merge(params: dict[str, np.ndarray], adapter: dict[str, tuple[np.ndarray, np.ndarray]], scale: float) -> dict[str, np.ndarray]:
    return params | {n: params[n] + scale * (a @ b) for n, (a, b) in adapter.items()}


FORMAT = 1


def _write(uri: str, head: dict, arrays: dict[str, np.ndarray]) -> None:
    room = io.BytesIO()
    np.savez(room, head=np.frombuffer(json.dumps(head).encode(), np.uint8), **arrays)
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as out:
        out.write(room.getvalue())


def _read(uri: str, kind: str) -> tuple[dict, dict[str, np.ndarray]]:
    """(head, arrays); a file of another kind or format version is refused by name."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as stream:
        raw = stream.read()
    try:
        with np.load(io.BytesIO(raw), allow_pickle=False) as found:
            head = json.loads(found["head"].tobytes())
            arrays = {k: found[k] for k in found.files if k != "head"}
    except (ValueError, KeyError, OSError) as problem:
        raise ValueError(f"{uri} is no {kind}") from problem
    if head.get("kind") != kind or head.get("format_version") != FORMAT:
        raise ValueError(f"{uri} is no {kind} of format version {FORMAT} but {head.get('kind')} of {head.get('format_version')!r}")
    return head, arrays


def write_checkpoint(uri: str, config: Config, params: dict[str, np.ndarray], step: int | None = None, run: dict | None = None) -> None:
    """One file of all parameters with its configuration, step and what else is known of the run; nothing in it is executable."""
    _write(uri, {"kind": "checkpoint", "format_version": FORMAT, "config": asdict(config), "step": step, "run": run or {}}, params)


def read_checkpoint(uri: str) -> tuple[dict[str, np.ndarray], Config, dict]:
    """(parameters, configuration, head) of a checkpoint, whose format version must be this one's."""
    head, arrays = _read(uri, "checkpoint")
    config = {k: tuple(x) if isinstance(x, list) else x for k, x in head["config"].items()}
    return arrays, Config.of(**config), head


def average_files(uris: list[str], out: str) -> list[int | None]:
    """Average checkpoints into a new one, which notes the steps that went into it; gives those steps."""
    found = [read_checkpoint(u) for u in uris]
    steps = [head["step"] for *_, head in found]
    last = found[-1][2]
    write_checkpoint(out, found[-1][1], average([p for p, *_ in found]), last["step"], last["run"] | {"averaged_from": steps})
    return steps


def write_adapter(uri: str, adapter: dict[str, tuple[np.ndarray, np.ndarray]], scale: float, rank: int, base: str) -> None:
    arrays = {f"{n}/{k}": x for n, pair in adapter.items() for k, x in zip("AB", pair)}
    _write(uri, {"kind": "adapter", "format_version": FORMAT, "scale": scale, "rank": rank, "base": base}, arrays)


def read_adapter(uri: str) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], dict]:
    """(adapter, head with scale, rank and base)."""
    head, arrays = _read(uri, "adapter")
    return {k[:-2]: (x, arrays[k[:-2] + "/B"]) for k, x in arrays.items() if k.endswith("/A")}, head


#: Parts of a layer, a memory and a head, in the order in which archives hold them.
LAYER_PARTS = ("norm_in", "q", "k", "v", "norm_q", "norm_k", "gate", "out", "norm_post", "attn_gate", "norm_hada", "d1", "d2", "d3", "phi_pre", "phi_post", "phi_res", "b_res")
MEMORY_PARTS, HEAD_PARTS = ("tables", "key", "value", "taps"), ("probes", "proj", "bias")


def place_of(name: str) -> tuple[int, int, int, str]:
    """Where a tensor stands in an archive: embedding, layers, memories, the last norm, heads, then what isn't known."""
    owner, _, part = name.rpartition(".")
    at = lambda parts: parts.index(part) if part in parts else len(parts)
    if name == "embedding":
        return 0, 0, 0, name
    if owner.startswith("layer") and owner[5:].isdigit():
        return 1, int(owner[5:]), at(LAYER_PARTS), name
    if owner.startswith("memory") and owner[6:].isdigit():
        return 2, int(owner[6:]), at(MEMORY_PARTS), name
    if name == "final_norm":
        return 3, 0, 0, name
    if owner in ("contrast", "confidence"):
        return 4, ("contrast", "confidence").index(owner), at(HEAD_PARTS), name
    return 5, 0, 0, name


def ordered(params: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    return sorted(params.items(), key=lambda x: place_of(x[0]))
