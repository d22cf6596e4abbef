"""Policy learning on the driver: a small network in numpy, roll-outs as Spark tasks.

Environments are shards of blocks; each task plays its shard with the broadcast weights, whose size is
fixed by the network and not by the data. The update itself is sequential and small.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.functions.blockmath import H_BINS, K_BINS, Q_BINS
from blockwright.operators.codec import _arrays, block_features
from blockwright.operators import rollout as RO
from blockwright.operators.environment import RewardConfig, block_step

HEADS = {"split": 1, "q": len(Q_BINS), "k": len(K_BINS), "h": len(H_BINS), "v": 1}


@dataclass
class PPOConfig:
    lr: float = 3e-4
    epochs: int = 3
    minibatch: int = 256
    gamma: float = 0.99
    lam: float = 0.95
    clip: float = 0.2
    entropy: float = 0.005
    value: float = 0.5
    max_norm: float = 1.0
    hidden: int = 128
    seed: int = 1004


class PolicyNet:
    """obs -> two hidden layers -> split, q, k, h and value heads."""

    def __init__(self, n_in: int, hidden: int = 128, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [("a", n_in, hidden), ("b", hidden, hidden), *((n, hidden, k) for n, k in HEADS.items())]
        self.p = {}
        for name, a, b in sizes:
            self.p[f"{name}_w"], self.p[f"{name}_b"] = rng.normal(0, (2 / a) ** 0.5 * (0.1 if name in HEADS else 1), (a, b)), np.zeros(b)

    def forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        a = np.maximum(x @ p["a_w"] + p["a_b"], 0)
        b = np.maximum(a @ p["b_w"] + p["b_b"], 0)
        return {"x": x, "a": a, "b": b} | {n: b @ p[f"{n}_w"] + p[f"{n}_b"] for n in HEADS}

    def backward(self, f: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of all weights from those of the heads' outputs."""
        out, db = {}, np.zeros_like(f["b"])
        for n, g in grads.items():
            out[f"{n}_w"], out[f"{n}_b"] = f["b"].T @ g, g.sum(0)
            db += g @ self.p[f"{n}_w"].T
        db *= f["b"] > 0
        out["b_w"], out["b_b"] = f["a"].T @ db, db.sum(0)
        da = (db @ self.p["b_w"].T) * (f["a"] > 0)
        out["a_w"], out["a_b"] = f["x"].T @ da, da.sum(0)
        return out

    def act(self, x: np.ndarray) -> list[tuple[int, int, int]]:
        """The most likely action of each row."""
        f = self.forward(x)
        return [(Q_BINS[q], K_BINS[k], H_BINS[h]) for q, k, h in zip(*(f[n].argmax(1) for n in "qkh"), strict=True)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> PolicyNet:
        net = cls.__new__(cls)
        net.p = dict(np.load(io.BytesIO(data)))
        return net


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def rollout(blocks: DataFrame, net: PolicyNet, config: PPOConfig, reward: RewardConfig, turn: int = 0) -> DataFrame:
    """One sampled step per block: env_id is the task, t the block's turn in it."""
    data = net.to_bytes()
    shared = blocks.sparkSession.sparkContext.broadcast(data)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, t = TaskContext.get().partitionId(), PolicyNet.from_bytes(shared.value), 0
        rng = np.random.default_rng((config.seed, turn, part))
        for b in batches:
            pairs = list(_arrays(b))
            if not pairs:
                continue
            x = np.stack([block_features(px[..., 0]) for _, px in pairs]).astype(np.float64)
            f = own.forward(x)
            logs = {n: log_softmax(f[n]) for n in "qkh"}
            acts = np.stack([[rng.choice(len(row), p=np.exp(row)) for row in logs[n]] for n in "qkh"], 1)
            logp = sum(logs[n][np.arange(len(x)), acts[:, i]] for i, n in enumerate("qkh"))
            info = [block_step(px, row["x"], row["y"], Q_BINS[a], K_BINS[c], H_BINS[h], reward) for (row, px), (a, c, h) in zip(pairs, acts, strict=True)]
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(t, t + n)), pa.array(x.tolist()), pa.array(acts.tolist(), pa.list_(pa.int32())), pa.array(logp), pa.array(f["v"][:, 0]), *(pa.array([i[c] for i in info], pa.float64()) for c in ("reward", "bpp", "psnr", "msssim"))], ["env_id", "t", "obs", "act", "logp", "val", "rew", "bpp", "psnr", "msssim"])
            t += n

    return blocks.select("image_id", "leaf_no", "x", "y", "w", "h", "px").mapInArrow(play, "env_id int, t long, obs array<double>, act array<int>, logp double, val double, rew double, bpp double, psnr double, msssim double")


def advantages(rew: np.ndarray, val: np.ndarray, done: np.ndarray, gamma: float, lam: float) -> np.ndarray:
    out, a = np.zeros(len(rew)), 0.0
    for t in range(len(rew) - 1, -1, -1):
        live = 1.0 - done[t]
        a = rew[t] + gamma * (val[t + 1] if t + 1 < len(val) else 0.0) * live - val[t] + gamma * lam * live * a
        out[t] = a
    return out


@dataclass
class Trainer:
    net: PolicyNet
    config: PPOConfig
    step: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def loss_and_grads(self, obs, act, logp_old, adv, ret) -> tuple[float, dict[str, np.ndarray]]:
        c, n = self.config, len(obs)
        f = self.net.forward(obs)
        logs = {k: log_softmax(f[k]) for k in "qkh"}
        rows = np.arange(n)
        ratio = np.exp(sum(logs[k][rows, act[:, i]] for i, k in enumerate("qkh")) - logp_old)
        plain, cut = ratio * adv, np.clip(ratio, 1 - c.clip, 1 + c.clip) * adv
        entropy = {k: -(np.exp(logs[k]) * logs[k]).sum(1) for k in "qkh"}
        value = f["v"][:, 0] - ret
        loss = -np.minimum(plain, cut).mean() + c.value * (value**2).mean() - c.entropy * sum(e.mean() for e in entropy.values())
        pull = np.where(plain <= cut, -ratio * adv, 0.0) / n
        grads = {"v": (2 * c.value * value / n)[:, None]}
        for i, k in enumerate("qkh"):
            p = np.exp(logs[k])
            one = np.zeros_like(p)
            one[rows, act[:, i]] = 1
            grads[k] = pull[:, None] * (one - p) + c.entropy / n * p * (logs[k] + entropy[k][:, None])
        return float(loss), self.net.backward(f, grads)

    def update(self, obs, act, logp_old, adv, ret) -> list[float]:
        """Adam steps over shuffled minibatches, gradients cut to max_norm."""
        c, losses = self.config, []
        adv = (adv - adv.mean()) / (adv.std(ddof=1) + 1e-8)
        rng = np.random.default_rng((c.seed, self.step))
        for _ in range(c.epochs):
            order = rng.permutation(len(obs))
            for at in range(0, len(obs), c.minibatch):
                k = order[at : at + c.minibatch]
                loss, g = self.loss_and_grads(obs[k], act[k], logp_old[k], adv[k], ret[k])
                norm = np.sqrt(sum((x**2).sum() for x in g.values()))
                scale = min(1.0, c.max_norm / (norm + 1e-6))
                self.step += 1
                for name, x in g.items():
                    x = x * scale
                    self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * x
                    self.v[name] = 0.999 * self.v.get(name, 0.0) + 0.001 * x * x
                    self.net.p[name] = self.net.p[name] - c.lr * (self.m[name] / (1 - 0.9**self.step)) / (np.sqrt(self.v[name] / (1 - 0.999**self.step)) + 1e-8)
                losses.append(loss)
        return losses

    def save(self) -> tuple[str, bytes]:
        """(settings as JSON, weights and Adam's moments): a checkpoint."""
        out = io.BytesIO()
        np.savez(out, **self.net.p, **{f"adam_{n}/{k}": x for n, moments in (("m", self.m), ("v", self.v)) for k, x in moments.items()})
        return json.dumps({"config": asdict(self.config), "step": self.step}), out.getvalue()

    @classmethod
    def load(cls, settings: str, data: bytes) -> Trainer:
        """The trainer that `save` wrote; its next updates are those that the saved one would make."""
        s, arrays = json.loads(settings), dict(np.load(io.BytesIO(data)))
        net = PolicyNet.__new__(PolicyNet)
        net.p = {k: x for k, x in arrays.items() if "/" not in k}
        m, v = ({k.split("/")[1]: x for k, x in arrays.items() if k.startswith(f"adam_{n}/")} for n in "mv")
        return cls(net, PPOConfig(**s["config"]), s["step"], m, v)


def _means(steps: DataFrame) -> dict[str, float]:
    return steps.agg(F.avg("rew").alias("reward"), F.avg("bpp").alias("bpp"), F.avg("psnr").alias("psnr")).first().asDict()


def validate(blocks: DataFrame, net: PolicyNet, config: PPOConfig | None = None, reward: RewardConfig | None = None, turn: int = 0) -> dict[str, float]:
    """Mean reward, bpp and psnr of all blocks under sampled actions, without an update."""
    return _means(rollout(blocks, net, config or PPOConfig(), reward or RewardConfig(), turn))


def sampled_steps(steps: DataFrame, config: PPOConfig, turn: int, sample: int):
    """At most `sample` steps, drawn by hash, with the advantages that they have among all steps of their task."""
    adv = RO.gae(steps.select("env_id", "t", "rew", "val", F.lit(False).alias("done")), config.gamma, config.lam)
    drawn = steps.orderBy(F.xxhash64("env_id", "t", F.lit(turn))).limit(sample)
    return drawn.join(adv, ["env_id", "t"]).toPandas().sort_values(["env_id", "t"])


def train(blocks: DataFrame, iterations: int, config: PPOConfig | None = None, reward: RewardConfig | None = None, sample: int = 4096) -> tuple[Trainer, list[dict]]:
    """Alternate roll-outs and updates; an iteration learns from `sample` steps at most, a documented bound on what the driver gets.

    Advantages and the means of the history are those of all steps, taken before the sample is drawn.
    """
    config, reward = config or PPOConfig(), reward or RewardConfig()
    trainer, history = Trainer(PolicyNet(18, config.hidden, config.seed), config), []
    for turn in range(iterations):
        steps = rollout(blocks, trainer.net, config, reward, turn).persist()
        r = sampled_steps(steps, config, turn, sample)
        losses = trainer.update(np.stack(r.obs), np.stack(r.act).astype(int), r.logp.to_numpy(), r.advantage.to_numpy(), r.ret.to_numpy())
        history.append({"iteration": turn} | _means(steps) | {"loss": float(np.mean(losses))})
        steps.unpersist()
    return trainer, history
