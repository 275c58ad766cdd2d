"""Hidden Markov models over sequences (seq_id, symbols ARRAY<INT>), and sparse Bayesian classification."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The cost of an impossible step, and the least emission probability that training leaves.
IMPOSSIBLE, FLOOR = 1e52, 1e-10
#: Rows that a task yields at once.
FRAME_ROWS = 1 << 16


class HiddenMarkov:
    """States, alphabet, start (pi), transitions (a) and emissions (b)."""

    def __init__(self, states, alphabet, transitions=None, emissions=None, start=None, seed: int = 0):
        named = lambda x: [str(k) for k in range(x)] if isinstance(x, int) else list(x)
        self.states, self.alphabet = named(states), named(alphabet)
        n, m, draw = len(self.states), len(self.alphabet), np.random.default_rng(seed)
        even = lambda x: x / x.sum(axis=1, keepdims=True)
        self.a = even(draw.random((n, n))) if transitions is None else np.asarray(transitions, dtype=float)
        self.b = even(draw.random((n, m))) if emissions is None else np.asarray(emissions, dtype=float)
        self.pi = np.full(n, 1.0 / n) if start is None else np.asarray(start, dtype=float)

    def forward(self, seq) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables (state, time) and the scales."""
        out, scale = np.zeros((len(self.pi), len(seq))), np.zeros(len(seq))
        for t, s in enumerate(seq):
            x = self.b[:, s] * (self.pi if t == 0 else out[:, t - 1] @ self.a)
            scale[t] = x.sum()
            out[:, t] = x / scale[t] if scale[t] else x
        return out, scale

    def backward(self, seq, scale: np.ndarray) -> np.ndarray:
        safe = np.where(scale == 0, 1.0, scale)
        out = np.zeros((len(self.pi), len(seq)))
        out[:, -1] = 1.0 / safe[-1]
        for t in range(len(seq) - 2, -1, -1):
            out[:, t] = self.a @ (self.b[:, seq[t + 1]] * out[:, t + 1]) / safe[t]
        return out

    def gamma(self, seq) -> np.ndarray:
        """State posteriors (state, time)."""
        f, scale = self.forward(seq)
        g = f * self.backward(seq, scale)
        return g / np.maximum(g.sum(axis=0), 1e-300)

    def xi(self, seq) -> np.ndarray:
        """Transition posteriors (time, from, to)."""
        f, scale = self.forward(seq)
        b = self.backward(seq, scale)
        out = f[:, :-1].T[:, :, None] * self.a * (self.b[:, seq[1:]] * b[:, 1:]).T[:, None, :]
        return out / np.maximum(out.sum(axis=(1, 2), keepdims=True), 1e-300)

    def likelihood(self, seq) -> float:
        scale = self.forward(seq)[1]
        return float(np.exp(np.log(scale).sum())) if (scale > 0).all() else 0.0

    def viterbi(self, seq) -> tuple[list[int], float]:
        """The likeliest path, lowest states first among equals, and its probability."""
        cost = lambda x: np.where(x > 0, -np.log(np.where(x > 0, x, 1.0)), IMPOSSIBLE)
        a, b = cost(self.a), cost(self.b)
        now, back = cost(self.pi) + b[:, seq[0]], []
        for s in seq[1:]:
            options = now[:, None] + a
            back.append(options.argmin(axis=0))
            now = options.min(axis=0) + b[:, s]
        path = [int(now.argmin())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1], float(np.exp(-now.min()))

    def over(self, sequences: DataFrame, what: str) -> DataFrame:
        """Every sequence's forward, backward, gamma (seq_id, t, state, v), xi (also state2) or likelihood (seq_id, v)."""

        n = len(self.pi)

        def values(seq):
            """One row a time, with a column for each state or pair of states."""
            if what == "xi":
                return self.xi(seq).reshape(-1, n * n)
            f, scale = self.forward(seq)
            return {"forward": lambda: f, "backward": lambda: self.backward(seq, scale), "gamma": lambda: self.gamma(seq)}[what]().T

        def parts(frame):
            """(seq_id, t, state, state2, v) as arrays of FRAME_ROWS at most."""
            for name, symbols in zip(frame["seq_id"], frame["symbols"]):
                seq = list(symbols)
                if what == "likelihood":
                    yield [name], [-1], [-1], [-1], [self.likelihood(seq) if seq else 1.0]
                elif seq:
                    x = values(seq)
                    step = max(1, FRAME_ROWS // x.shape[1])
                    for t in range(0, len(x), step):
                        v = x[t : t + step]
                        at, state = np.indices(v.shape)
                        yield np.full(v.size, name), at.ravel() + t, *((state.ravel() // n, state.ravel() % n) if what == "xi" else (state.ravel(), np.full(v.size, -1))), v.ravel()

        def run(frames):
            import pandas as pd

            whole = lambda held: pd.DataFrame(dict(zip(["seq_id", "t", "state", "state2", "v"], map(np.concatenate, zip(*held)))))
            for frame in frames:
                held, size = [], 0
                for part in parts(frame):
                    if held and size + len(part[0]) > FRAME_ROWS:
                        yield whole(held)
                        held, size = [], 0
                    held.append(part)
                    size += len(part[0])
                if held:
                    yield whole(held)

        rows = sequences.select("seq_id", "symbols").mapInPandas(run, "seq_id long, t int, state int, state2 int, v double")
        return rows.select("seq_id", "v") if what == "likelihood" else rows if what == "xi" else rows.drop("state2")

    def transitions(self, spark) -> DataFrame:
        """(state, state2, v) by name."""
        return spark.createDataFrame([(a, b, float(self.a[i, j])) for i, a in enumerate(self.states) for j, b in enumerate(self.states)], "state string, state2 string, v double")

    def emissions(self, spark) -> DataFrame:
        """(state, symbol, v) by name."""
        return spark.createDataFrame([(a, b, float(self.b[i, j])) for i, a in enumerate(self.states) for j, b in enumerate(self.alphabet)], "state string, symbol string, v double")

    def decode(self, sequences: DataFrame) -> DataFrame:
        """(seq_id, path, probability) of every sequence."""

        def run(frames):
            for frame in frames:
                found = [self.viterbi(list(s)) if len(s) else ([], 1.0) for s in frame["symbols"]]
                yield frame[["seq_id"]].assign(path=[f[0] for f in found], probability=[f[1] for f in found])

        return sequences.select("seq_id", "symbols").mapInPandas(run, "seq_id long, path array<int>, probability double")

    def train(self, sequences: DataFrame, rounds: int = 500, tol: float = 1e-15) -> float:
        """Baum-Welch over all sequences; tasks sum expected counts. The mean log probability of the last step."""
        n, m = self.b.shape
        before, mean = -np.inf, -np.inf
        for _ in range(rounds):

            def expected(frames):
                import pandas as pd

                total, logs, count = np.zeros(n + n * n + n + n * m), 0.0, 0
                for frame in frames:
                    for s in frame["symbols"]:
                        seq = list(s)
                        if seq:
                            g, scale = self.gamma(seq), self.forward(seq)[1]
                            hit = np.zeros((len(seq), m))
                            hit[np.arange(len(seq)), seq] = 1.0
                            total += np.concatenate([g[:, 0], self.xi(seq).sum(axis=0).ravel(), g[:, :-1].sum(axis=1), (g @ hit).ravel()])
                            logs += float(np.where(scale > 0, np.log(np.where(scale > 0, scale, 1.0)), -IMPOSSIBLE).sum())
                            count += 1
                yield pd.DataFrame({"s": [total.tolist()], "l": [logs], "n": [count]})

            parts = sequences.select("symbols").mapInPandas(expected, "s array<double>, l double, n long").collect()  # one row a task
            total, count = np.sum([p["s"] for p in parts], axis=0), max(1, sum(p["n"] for p in parts))
            mean = sum(p["l"] for p in parts) / count
            if mean - before < tol:
                break
            before = mean
            pi, xi, g, b = np.split(total, [n, n + n * n, 2 * n + n * n])
            self.pi, self.a = pi / count, xi.reshape(n, n) / np.maximum(g, 1e-300)[:, None]
            b = b.reshape(n, m)
            self.b = np.maximum(b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300), FLOOR)
        return float(mean)

    def generate(self, length: int, seed: int = 0) -> list[int]:
        draw = np.random.default_rng(seed)
        state, out = pick(self.pi, draw), []
        for _ in range(length):
            out.append(self.generate_symbol(state, draw))
            state = pick(self.a[state], draw)
        return out

    def generate_symbol(self, state: int, draw: np.random.Generator) -> int:
        """A symbol by the emissions of a state."""
        return pick(self.b[state], draw)

    def idx_to_states(self, df: DataFrame, column: str = "idx") -> DataFrame:
        """Adds name, the state of a number."""
        return self._named(df, column, self.states)

    def idx_to_symbols(self, df: DataFrame, column: str = "idx") -> DataFrame:
        """Adds name, the symbol of a number."""
        return self._named(df, column, self.alphabet)

    def _named(self, df: DataFrame, column: str, names: list[str]) -> DataFrame:
        return df.withColumn("name", F.try_element_at(F.array(*[F.lit(n) for n in names]), F.col(column).cast("int") + 1))

    def encode(self, df: DataFrame, column: str, names: str = "alphabet") -> DataFrame:
        """Adds idx, the number of a symbol or state."""
        table = df.sparkSession.createDataFrame([(s, k) for k, s in enumerate(getattr(self, names))], "_s string, idx int")
        return df.join(F.broadcast(table), F.col(column) == F.col("_s"), "left").drop("_s")  # the model's own names


def pick(chances: np.ndarray, draw: np.random.Generator) -> int:
    return int(draw.choice(len(chances), p=chances / chances.sum()))


class RelevanceVectors:
    """Tipping's sparse Bayesian classifier on a design matrix that fits the driver."""

    def __init__(self, used=(), weights=(), bias: float = 0.0):
        self.used, self.weights, self.bias, self.marginal = np.array(used, dtype=int), np.array(weights, dtype=float), bias, math.nan

    def train(self, phi: np.ndarray, t: np.ndarray, alpha: float | None = None, bias: bool = True, rounds: int = 10_000) -> RelevanceVectors:
        x = np.hstack([phi, np.ones((len(phi), 1))]) if bias else phi
        a = np.full(x.shape[1], 1.0 / len(x) ** 2 if alpha is None else alpha)
        used, w = np.arange(x.shape[1]), np.zeros(x.shape[1])
        for _ in range(rounds):
            keep = a < 1e9
            used, a, w = used[keep], a[keep], w[keep]
            if not len(used):
                break
            w, cov, loglik = posterior_mode(x[:, used], t, w, a)
            self.marginal = loglik + 0.5 * (np.linalg.slogdet(cov)[1] + np.log(a).sum())
            new = np.maximum(1 - a * np.diag(cov), 1e-12) / np.maximum(w * w, 1e-300)
            shift, a = np.abs(np.log(new) - np.log(a)).max(), new
            if shift < 1e-3:
                break
        self.bias = float(w[used == phi.shape[1]].sum()) if bias else 0.0
        inner = used < phi.shape[1]
        self.used, self.weights = used[inner], w[inner]
        return self

    def get_relevance_vectors(self, spark) -> DataFrame:
        """(idx, weight) of the columns that are left, the bias as idx -1."""
        rows = [(int(i), float(w)) for i, w in zip(self.used, self.weights)]
        return spark.createDataFrame([*rows, *([(-1, float(self.bias))] if self.bias else [])], "idx long, weight double")

    def classify_rows(self, rows: DataFrame) -> DataFrame:
        """(i, c, p) of rows (i, x): the class and its probability, task by task."""
        model = self

        def run(frames):
            for frame in frames:
                found = model.classify(np.stack(frame["x"].to_numpy())) if len(frame) else np.zeros((0, 2))
                yield frame[["i"]].assign(c=found[:, 0].astype(int), p=found[:, 1])

        return rows.select("i", "x").mapInPandas(run, "i long, c int, p double")

    def classify(self, phi: np.ndarray) -> np.ndarray:
        """Class (0 or 1) and the probability of the predicted class, for each row."""
        y = phi[:, self.used] @ self.weights + self.bias
        p = 1 / (1 + np.exp(-y))
        return np.stack([(y > 0).astype(float), np.where(y > 0, p, 1 - p)], axis=1)


def bernoulli(x):
    """x (1 - x)."""
    return x * (1 - x)


def posterior_mode(x: np.ndarray, t: np.ndarray, w: np.ndarray, a: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """Newton steps with halving: the mode, the inverse Hessian, and the log likelihood with its penalty."""

    def value(w):
        z = x @ w
        return float((t * z - np.logaddexp(0, z)).sum() - 0.5 * (a * w * w).sum())

    now = value(w)
    for step in range(rounds):
        y = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (t - y) - a * w
        hessian = (x * bernoulli(y)[:, None]).T @ x + np.diag(a)
        if step and np.linalg.norm(gradient) / len(w) < 1e-6:
            break
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size >= 2**-8 and value(w + size * move) < now:
            size /= 2
        if size < 2**-8:
            break
        w = w + size * move
        now = value(w)
    y = 1 / (1 + np.exp(-(x @ w)))
    return w, np.linalg.inv((x * bernoulli(y)[:, None]).T @ x + np.diag(a)), now
