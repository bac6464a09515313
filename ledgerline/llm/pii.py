"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network, trained in numpy on windows whose labels are base spans, some of them rewritten
in ways the patterns miss, adds spans. It reads windows of WINDOW characters that overlap by half. Every span it may
return has a digit or an at sign, so a window without either decodes to nothing and isn't run. The scores of overlapping
windows are merged by character, and one best path over each run of windows gives the tags of the text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slabs, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns of the contract. A look-behind that changes no match keeps long runs of digits linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")

WINDOW, STEP = 128, 64
#: Documents and windows the network is trained on at most, and its sizes.
DOCUMENTS, SAMPLE, EMBED, HIDDEN, ROUNDS, BATCH, SEED = 400, 1200, 10, 14, 220, 48, 11

_symbols = {c: i + 6 for i, c in enumerate(" .,-_+@()%:/\\\"'#*$&|=<>[]{}!?;~^`\n\t")}
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2 k begin of kind k, 2 + 2 k inside of it


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    end, i = 0, text.find("@")
    while i >= 0:
        s = i
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, i + 1) if s < i else None
        if m:
            end = m.end()
            yield s, end
        i = text.find("@", max(i + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    if not TRIGGER.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def symbols(text: str) -> np.ndarray:
    """Character classes: 1 digit, 2 and 3 lower and upper ASCII letter, 4 other letter, 5 other, then each common sign; 0 is padding."""
    return np.array([1 if "0" <= c <= "9" else 2 if "a" <= c <= "z" else 3 if "A" <= c <= "Z" else _symbols.get(c) or (4 if c.isalpha() else 5) for c in text], np.int64)


def tags_of(n: int, spans: list[tuple[int, int, int]], base: int = 0) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for s, k, e in spans:
        a, b = max(s - base, 0), min(e - base, n)
        if a < b:
            tags[a:b] = 2 + 2 * k
            if s >= base:
                tags[a] = 1 + 2 * k
    return tags


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray):
    """States (T, B, H) for gate inputs x (T, B, 4 H), already multiplied; and what the way back needs."""
    steps, batch, wide = x.shape
    n = wide // 4
    h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    out, gates, cells = np.empty((steps, batch, n), x.dtype), np.empty_like(x), np.empty((steps, batch, n), x.dtype)
    for t in range(steps):
        g = x[t] + h @ u
        g[:, : 3 * n] = sigmoid(g[:, : 3 * n])
        g[:, 3 * n :] = np.tanh(g[:, 3 * n :])
        c = g[:, n : 2 * n] * c + g[:, :n] * g[:, 3 * n :]
        h = g[:, 2 * n : 3 * n] * np.tanh(c)
        out[t], gates[t], cells[t] = h, g, c
    return out, (gates, cells, u)


def lstm_back(d: np.ndarray, out: np.ndarray, cache):
    """Gradients of the gate inputs and of u."""
    gates, cells, u = cache
    steps, batch, n = d.shape
    dx, du = np.empty_like(gates), np.zeros_like(u)
    dh, dc = np.zeros((batch, n), d.dtype), np.zeros((batch, n), d.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * n : (k + 1) * n] for k in range(4))
        tc = np.tanh(cells[t])
        dh = dh + d[t]
        dc = dc + dh * o * (1 - tc * tc)
        before = cells[t - 1] if t else 0
        dx[t] = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
        if t:
            du += out[t - 1].T @ dx[t]
        dh, dc = dx[t] @ u.T, dc * f
    return dx, du


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"e": make(6 + len(_symbols), EMBED), "o": make(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS, np.float32), "tr": make(TAGS, TAGS) * 0.1}
        for way in "fb":
            self.p |= {"w" + way: make(EMBED, 4 * HIDDEN), "u" + way: make(HIDDEN, 4 * HIDDEN), "b" + way: np.zeros(4 * HIDDEN, np.float32)}
            self.p["b" + way][HIDDEN : 2 * HIDDEN] = 1
        self.fix()

    def fix(self) -> None:
        """An inside tag only follows the begin or inside of its kind."""
        self.allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True

    def emissions(self, x: np.ndarray):
        """Scores (T, B, TAGS) of symbols x (T, B)."""
        p, e = self.p, self.p["e"][x]
        fwd, cf = lstm((p["e"] @ p["wf"] + p["bf"])[x], p["wf"], p["uf"])
        bwd, cb = lstm((p["e"] @ p["wb"] + p["bb"])[x[::-1]], p["wb"], p["ub"])
        both = np.concatenate((fwd, bwd[::-1]), 2)
        return both @ p["o"] + p["ob"], (e, fwd, cf, bwd, cb, both)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of tags y (T, B), and gradients."""
        p, (score, (e, fwd, cf, bwd, cb, both)) = self.p, self.emissions(x)
        steps, batch = x.shape
        tr = np.where(self.allowed, p["tr"], -30).astype(np.float32)
        ex, m = np.exp(tr), score.max(2, keepdims=True)
        em = np.exp(score - m)
        alpha, beta, z = np.empty_like(em), np.empty_like(em), np.zeros(batch)
        a = em[0]
        for t in range(steps):
            a = a if t == 0 else (a @ ex) * em[t]
            s = a.sum(1, keepdims=True)
            a = a / s
            alpha[t], z = a, z + np.log(s[:, 0]) + m[t, :, 0]
        b = np.ones((batch, TAGS), np.float32)
        dtr = np.zeros_like(tr)
        for t in range(steps - 1, -1, -1):
            beta[t] = b
            if t:
                right = em[t] * b
                joint = (alpha[t - 1][:, :, None] * ex[None]) * right[:, None, :]
                dtr += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                b = right @ ex.T
                b = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        at = np.arange(steps)[:, None], np.arange(batch)[None]
        gold = score[(*at, y)].sum(0) + tr[y[:-1], y[1:]].sum(0)
        d = post
        d[(*at, y)] -= 1
        np.subtract.at(dtr, (y[:-1].ravel(), y[1:].ravel()), 1)
        d, n = d / batch, HIDDEN
        grad = {"tr": np.where(self.allowed, dtr / batch, 0).astype(np.float32), "o": np.tensordot(both, d, ([0, 1], [0, 1])), "ob": d.sum((0, 1))}
        back = d @ p["o"].T
        de = np.zeros_like(e)
        for way, out, cache, g in (("f", fwd, cf, back[:, :, :n]), ("b", bwd, cb, back[::-1, :, n:])):
            dx, grad["u" + way] = lstm_back(g, out, cache)
            inp = e if way == "f" else e[::-1]
            grad["w" + way], grad["b" + way] = np.tensordot(inp, dx, ([0, 1], [0, 1])), dx.sum((0, 1))
            dx = dx @ p["w" + way].T
            de += dx if way == "f" else dx[::-1]
        grad["e"] = np.zeros_like(p["e"])
        np.add.at(grad["e"], x.ravel(), de.reshape(-1, EMBED))
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.02, seed: int = SEED) -> None:
        """Adam over random batches of rows of x and y (N, T)."""
        rng, first, second = np.random.default_rng(seed), {k: 0 for k in self.p}, {k: 0 for k in self.p}
        for r in range(1, rounds + 1):
            i = rng.integers(0, len(x), min(BATCH, len(x)))
            _, grad = self.step(x[i].T, y[i].T)
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            pace = rate * min(1, 2 * (1 - r / (rounds + 1)))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - pace * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)).astype(np.float32)

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Best tags (N, T) of scores (T, N, TAGS), by Viterbi."""
        tr = np.where(self.allowed, self.p["tr"], -1e4).astype(np.float32)
        best, back = score[0].copy(), np.zeros(score.shape, np.int8)
        best[:, 2::2] -= 2  # a window may open inside a span
        for t in range(1, len(score)):
            way = best[:, :, None] + tr[None]
            back[t] = way.argmax(1)
            best = way.max(1) + score[t]
        out = np.zeros(score.shape[:2], np.int64)
        out[-1] = best.argmax(1)
        for t in range(len(score) - 1, 0, -1):
            out[t - 1] = back[t][np.arange(out.shape[1]), out[t]]
        return out.T

    def tags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and tags of the characters that each text's windows cover.

        Windows that overlap form a run. A character's scores are the mean of its windows' scores, weighted by how far it is
        from their ends, and the best path is sought over the run as a whole, so that windows cannot disagree about a span. A run of more
        than PIECE windows is decoded in pieces that share OVER windows; each gives the tags up to the middle of what it shares.
        """
        work = [(i, s) for i, t in enumerate(texts) for s in windows_of(t)]
        weight = (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)[:, None]
        runs: list[list[int]] = []
        for k, (i, s) in enumerate(work):
            if runs and work[runs[-1][-1]] == (i, s - STEP):
                runs[-1].append(k)
            else:
                runs.append([k])
        found = []  # text, first position, tags
        for group in split_runs(sorted((p for run in runs for p in pieces(run)), key=lambda p: len(p[0]))):
            long = (len(group[-1][0]) - 1) * STEP + WINDOW
            total, mass = np.zeros((long, len(group), TAGS), np.float32), np.zeros((long, len(group), 1), np.float32)
            places = [(r, n, k) for r, (run, _, _) in enumerate(group) for n, k in enumerate(run)]
            for a in range(0, len(places), 512):
                part = places[a : a + 512]
                score = self.emissions(np.concatenate([padded(texts[work[k][0]], [work[k][1]]) for _, _, k in part]).T)[0]
                for c, (r, n, _) in enumerate(part):
                    total[n * STEP : n * STEP + WINDOW, r] += score[:, c] * weight
                    mass[n * STEP : n * STEP + WINDOW, r] += weight
            best = self.decode(total / np.maximum(mass, 1))
            for (run, before, behind), row in zip(group, best, strict=True):
                i, s = work[run[0]]
                lo, hi = max(s + before, 0), min(s + (len(run) - 1) * STEP + WINDOW - behind, len(texts[i]))
                found.append((i, lo, row[lo - s : hi - s]))
        out: list[tuple[list, list]] = [([], []) for _ in texts]
        for i, lo, tags in sorted(found, key=lambda x: x[:2]):
            out[i][0].append(np.arange(lo, lo + len(tags)))
            out[i][1].append(tags)
        return [(np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *tag])) for at, tag in out]


#: Windows of a run that are decoded as one at most, and those that two pieces of a longer run share.
PIECE, OVER = 1024, 8


def pieces(run: list[int]) -> list[tuple[list[int], int, int]]:
    """A run of windows as pieces, each with the characters at its start and at its end that its neighbours give."""
    starts = range(0, max(1, len(run) - OVER), PIECE - OVER)
    middle = (OVER - 1) * STEP // 2 + WINDOW // 2
    behind = (OVER - 1) * STEP + WINDOW - middle
    return [(run[a : a + PIECE], middle if a else 0, behind if a + PIECE < len(run) else 0) for a in starts]


def split_runs(runs: list[tuple[list[int], int, int]], most: int = 1024):
    """Runs by length in groups of at most `most` windows."""
    held: list[tuple[list[int], int, int]] = []
    for run in runs:
        if held and (len(held) + 1) * len(run[0]) > most:
            yield held
            held = []
        held.append(run)
    if held:
        yield held


def rewritten(text: str, spans: list, rng) -> tuple[str, list]:
    """A window with its spans written in ways the patterns miss: phones without plus, cards with dots, addresses in brackets."""
    out, moved, at = [], [], 0
    for s, k, e in spans:
        span = text[s:e]
        if k == 3:
            span = [span.lstrip("+"), span.split(" ", 1)[-1], span.replace("+", "00")][rng.integers(3)]
        elif k == 2:
            d = digits_of(span)
            span = "./_"[rng.integers(3)].join(d[i : i + 4] for i in range(0, len(d), 4))
        elif k == 0:
            span = span.replace("@", [" @ ", "[@]", "(@)"][rng.integers(3)])
        out.append(text[at:s])
        start = sum(map(len, out))
        out.append(span)
        moved.append((start, k, start + len(span)))
        at = e
    return "".join(out) + text[at:], moved


def windows_of(text: str) -> list[int]:
    """Starts of the windows that have a digit or an at sign; -STEP // 2 is the first."""
    starts = set()
    for m in TRIGGER.finditer(text):
        i = m.start()
        lo = -(-(i + STEP // 2 - WINDOW + 1) // STEP)
        starts.update(range(max(0, lo), (i + STEP // 2) // STEP + 1))
    return [k * STEP - STEP // 2 for k in sorted(starts) if k * STEP < len(text)]


def padded(text: str, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.int64)
    for r, s in enumerate(starts):
        a = max(s, 0)
        part = symbols(text[a : s + WINDOW])
        out[r, a - s : a - s + len(part)] = part
    return out


#: What any base span contains: an address's sign between letters, or digits with signs between them.
LIKELY = r"[A-Za-z0-9]@[A-Za-z0-9]|[0-9]{1,3}(\.[0-9]{1,3}){3}|[0-9]([ -]?[0-9]){13}|\+[0-9][ ().0-9-]{8}"


def train(docs: DataFrame) -> Network | None:
    """A network trained on windows of at most DOCUMENTS texts with a digit or an at sign, those of the smallest hash.

    If these hold no base span, texts that look like holding one are drawn; None if there is none either: nothing can be learnt then.

    docs: text; other columns are ignored. Null and empty texts, and an empty table, teach nothing; equal texts count once. Of
    long texts all windows are candidates.
    """

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                spans = base_spans(text)
                for s in windows_of(text):
                    part = [x for x in spans if x[0] >= s and x[2] <= s + WINDOW]
                    if part or not any(x[0] < s + WINDOW and x[2] > s for x in spans):
                        out.append((text[max(s, 0) : s + WINDOW], bool(part)))
            yield pa.RecordBatch.from_pydict({"window": pa.array([x[0] for x in out], pa.string()), "hit": pa.array([x[1] for x in out], pa.bool_())})

    own = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))

    def drawn(texts: DataFrame) -> list:
        # of distinct texts, so that copies don't crowd out others: about four times as many as asked for go on to the ranking
        distinct = texts.agg(F.approx_count_distinct("text", 0.02)).first()[0]
        some = texts.where(place < F.lit(int(4 * DOCUMENTS * (1 << 30) / max(1, distinct)))).distinct().orderBy(place, "text").limit(DOCUMENTS)
        return some.mapInArrow(run, "window string, hit boolean").distinct().orderBy(F.desc("hit"), F.xxhash64("window")).limit(SAMPLE).collect()

    seen = drawn(own)
    if not any(r.hit for r in seen):
        seen = drawn(own.where(F.col("text").rlike(LIKELY)))  # spans are rare: draw among texts that may hold one
    if not any(r.hit for r in seen):
        return None
    rng, x, y = np.random.default_rng(SEED), [], []
    for r in sorted(seen, key=lambda r: r.window):
        spans, ends = [], 0
        for s, k, e in base_spans(r.window):
            if s >= ends:
                spans.append((s, k, e))
                ends = e
        for text, found in [(r.window, spans), *([rewritten(r.window, spans, rng)] if spans else [])]:
            tags = np.zeros(WINDOW, np.int64)
            tags[: len(text)] = tags_of(len(text), found)[:WINDOW]
            x.append(np.pad(symbols(text[:WINDOW]), (0, max(0, WINDOW - len(text)))))
            y.append(tags)
    network = Network()
    network.fit(np.stack(x), np.stack(y))
    return network


def plausible(span: str, kind: int) -> bool:
    d = digits_of(span)
    if kind == 0:
        return "@" in span and "." in span and len(span) >= 6
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15


def read_tags(text: str, tags: np.ndarray, base: list) -> list[tuple[int, int, int]]:
    """Plausible spans of the tags that overlap no base span."""
    out = []
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (tags[at[1:]] % 2 == 1) | ((tags[at[1:]] - 1) // 2 != (tags[at[:-1]] - 1) // 2)
    for a, b in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], len(at)], strict=True):
        s, e, k = int(at[a]), int(at[b - 1]) + 1, int(tags[at[a]] - 1) // 2
        while s < e and text[s] in " .,;:":
            s += 1
        while s < e and text[e - 1] in " .,;:":
            e -= 1
        if s < e and plausible(text[s:e], k) and not any(x[0] < e and s < x[2] for x in base):
            out.append((s, k, e))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, network: Network | None, redact: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and, if asked for, redacted.

    Counts and digest are of the base spans; spans also has the network's, none of which overlaps a base span. Spans that start
    together are in the order of KINDS. Positions are code points. Null text is empty, long texts are read whole. Repeated
    rows are each returned, further columns are ignored, of whatever name; an empty table gives an empty result. Without a
    network only base spans are found.
    """

    def extra(texts: list[str], base: list[list]) -> list[list]:
        out = []
        for t, b, (at, tag) in zip(texts, base, network.tags(texts), strict=True):
            tags = np.zeros(len(t), np.int64)
            tags[at] = tag
            out.append(read_tags(t, tags, b) if len(at) else [])
        return out

    def run(batches):
        for rows, _, _ in slabs(batches, "text", 1 << 20, 256):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            more = extra(texts, base) if network else [[]] * len(texts)
            out = {"doc_id": rows.column(0)}
            for k, name in enumerate(KINDS):
                out["n_" + name] = pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
            out["spans"] = pa.array([joined(b + m) for b, m in zip(base, more, strict=True)], pa.string())
            if redact:
                clean = []
                for t, b, m in zip(texts, base, more, strict=True):
                    end, kept = len(t), []
                    for s, k, e in sorted(b + m, reverse=True):
                        if e <= end:
                            kept[:0] = [f"<{KINDS[k]}>", t[e:end]]
                            end = s
                        else:
                            end = min(end, s)
                    clean.append(t[:end] + "".join(kept))
                out["redacted"] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redact
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op10_pii(spark, sf_dir):
    docs = table(spark, "documents", sf_dir).select("doc_id", "text")
    return find(docs, train(docs))
