"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field adds to them: its nodes are a text's
tokens that hold a digit or @, its labels none and the four kinds. A node's
potential comes from the token's shape and the words beside it (a linear
model), neighbours share a potential for their two labels, and tokens that
repeat or have the same digits all hang on one hub, a further node without a
potential of its own, by one that prefers equal labels; so it does not matter
how far apart they are or how many stand between. Two tokens on a hub are
bound as by a link of the trained potential. Loopy belief propagation spreads
what the base spans assert over each document; a node outside all base spans
whose belief in a kind reaches least_belief is a further span of that kind.

The field is trained here, on the candidate tokens of the most_documents
documents of least doc_id (then hash of the text) that have any, with the base
spans as labels; of each such document the first most_nodes tokens count. All
its weights are fitted together, by the pseudo-likelihood of the field: each
token's label given its own features and the labels of its neighbours and of
the tokens on its hubs. All else covers all texts as wholes.

Null text counts as empty: no spans. Offsets are code points, end exclusive.
Rows are independent; repeated rows need nothing special; with an empty table
or no candidate token the field adds nothing. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns. The email's, [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, is read from its @ in emails().
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
#: A run without white space and marks that holds a digit or @. It begins where a run does, so long runs are read once.
TOKEN = re.compile(r"(?<![^\s\"'<>()\[\]{},;])[^\s\"'<>()\[\]{},;0-9@]*+[0-9@][^\s\"'<>()\[\]{},;]*+")
FEATURES = 512
Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, in time in proportion to the text: what stands before an @, back to the last match or @, and the domain behind."""
    done, at = 0, text.find("@")
    while at >= 0:
        front = text[done:at]
        start = done + len(front.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def nodes(text: str) -> list[tuple[int, int]]:
    """The tokens with a digit or @, without the marks at their ends."""
    if "@" not in text and not DIGIT.search(text):
        return []
    return [(m.start(), m.start() + len(m[0].rstrip(".:!?="))) for m in TOKEN.finditer(text)]


def features(text: str, start: int, end: int) -> list[int]:
    """Places of the features of the token, by hash."""
    token = text[start:end]
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token[:200]))
    digits = sum(c.isdigit() for c in token)
    before, after = text[max(0, start - 24) : start].split(), text[end : end + 24].split()
    names = [
        "bias", f"shape {shape[:24]}", f"digits {min(digits, 20)}", f"length {min(len(token), 40) // 4}", f"at {'@' in token}", f"dots {min(token.count('.'), 4)}",
        f"front {token[0] if not token[0].isalnum() else 'a'}", f"before {re.sub('[0-9]', '9', before[-1][-6:]) if before and DIGIT.search(before[-1]) else ''}", f"after {re.sub('[0-9]', '9', after[0][:6]) if after and DIGIT.search(after[0]) else ''}",
    ]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def labels(tokens: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """For each token 1 + the kind of a base span that it meets, 0 without one."""
    out, k = [], 0
    for a, b in tokens:
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        hit = next((s for s in spans[max(0, k - 2) : k + 3] if s[0] < b and a < s[2]), None)
        out.append(1 + hit[1] if hit else 0)
    return out


def skip_keys(token: str) -> list[str]:
    """Tokens that share a key are linked: equal ones, and such of six or more equal digits."""
    digits = "".join(DIGIT.findall(token))
    return [f"t{token.lower()}", *([f"d{digits}"] if len(digits) >= 6 else [])]


def links(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Neighbours (at most 12 characters apart), and the groups of all tokens of a common key."""
    chain = [(i, i + 1) for i in range(len(tokens) - 1) if tokens[i + 1][0] - tokens[i][1] <= 12]
    of: dict[str, list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(tokens):
        for k in skip_keys(text[a:b]):
            of[k].append(i)
    return chain, sorted({tuple(x) for x in of.values() if len(x) > 1})


def train(rows: list[tuple[list[list[int]], list[int], list[tuple[int, int]], list[tuple[int, ...]]]], steps: int = 200) -> dict[str, np.ndarray]:
    """Weights from documents' features, labels, chain links and groups, by gradient steps on the pseudo-likelihood with a square penalty.

    A token's score for a label is the sum of its features' weights, of the chain weights to its
    neighbours' labels, and of the skip weight times the share of that label among the others of each of its groups.
    """
    n = len(KINDS) + 1
    unary, chain, skip = np.zeros((FEATURES, n)), np.zeros((n, n)), 1.0
    f = np.array([v for r in rows for v in r[0]], np.int64)
    if len(f):
        y = np.array([v for r in rows for v in r[1]], np.int64)
        first = np.cumsum([0, *[len(r[1]) for r in rows]]).tolist()
        pairs = np.array([(at + i, at + j) for at, r in zip(first, rows, strict=False) for i, j in r[2]], np.int64).reshape(-1, 2)
        left, right = pairs[:, 0], pairs[:, 1]
        hot = np.eye(n)[y]
        share = np.zeros((len(y), n))
        for at, r in zip(first, rows, strict=False):
            for group in r[3]:
                own = at + np.array(group)
                share[own] += (hot[own].sum(0) - hot[own]) / (len(own) - 1)
        for step in range(steps):
            score = unary[f].sum(1) + skip * share
            np.add.at(score, left, chain[:, y[right]].T)
            np.add.at(score, right, chain[y[left]])
            p = np.exp(score - score.max(1, keepdims=True))
            off = p / p.sum(1, keepdims=True) - hot
            rate = 4.0 / (1 + step / 50) / len(y)
            grad = np.zeros_like(unary)
            for j in range(f.shape[1]):
                np.add.at(grad, f[:, j], off)
            pair = np.zeros_like(chain)
            np.add.at(pair.T, y[right], off[left])
            np.add.at(pair, y[left], off[right])
            unary -= rate * grad + 1e-4 * unary
            chain -= rate * pair + 1e-3 * chain
            skip = min(4.0, max(0.5, skip - rate * float((off * share).sum())))
    return {"unary": unary, "chain": np.clip(chain, -1.5, 1.5), "skip": skip * np.eye(n)}


def hubs(n: int, groups: list[tuple[int, ...]], skip: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Edges from the tokens of each group to its hub, hubs numbered from n on.

    With weight h on a hub's edges, two tokens on it have (e^2h + k - 1) / (2e^h + k - 2)
    for equal labels against two unequal ones of k; h is such that this is e to the weight in skip.
    """
    k, w = len(skip), np.exp(skip[0, 0])
    factor = np.eye(k) * np.log(w + np.sqrt(w * w - (k - 1) + (k - 2) * w))
    return [(i, n + g, factor) for g, group in enumerate(groups) for i in group]


def beliefs(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], tolerance: float = 1e-5) -> np.ndarray:
    """Marginals of the nodes by loopy sum-product: all messages at once, damped by half, until no message is off by tolerance.

    Messages of strong and opposed loops may swing instead (no error smaller by a tenth in 100 rounds). Then
    steps are halved, and after four of them edges pass in shares (fractional belief propagation),
    ever smaller until messages settle: small shares make the free energy convex.
    Where none down to a tenth settles, the state whose messages were least off is taken.
    """
    n, k = unary.shape
    own = unary - unary.max(1, keepdims=True)
    if edges:
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        table = np.stack([e[2] for e in edges])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        factor = np.concatenate([table, table.transpose(0, 2, 1)])  # from the source's label to the target's
        back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
        message, share, step, least, since = np.zeros((len(source), k)), 1.0, 0.5, np.inf, 0
        nearest = (np.inf, message, share)
        while True:
            total = own.copy()
            np.add.at(total, target, share * message)
            out = (total[source] - message[back])[:, :, None] + factor / share
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None]).sum(1))
            change = new - new.max(1, keepdims=True) - message
            off = np.abs(change).max()
            if off < nearest[0]:
                nearest = off, message, share
            if off < tolerance:
                break
            message = message + step * change
            least, since = (off, 0) if off < 0.9 * least else (least, since + 1)
            if since == 100:
                step, least, since = step / 2, np.inf, 0
                if step < 0.05:
                    message, share, step = np.zeros_like(message), share * 0.8, 0.5
                if share < 0.1:
                    break
        _, message, share = nearest
        own = own.copy()
        np.add.at(own, target, share * message)
    p = np.exp(own - own.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(text: str, model: dict[str, np.ndarray] | None, least_belief: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, in order."""
    base = base_spans(text)
    tokens = nodes(text) if model else []
    known = labels(tokens, base)
    if all(known):  # nothing to add
        return base, base
    unary = model["unary"][np.array([features(text, a, b) for a, b in tokens])].sum(1)
    for i, v in enumerate(known):
        if v:
            unary[i] = -8.0
            unary[i, v] = 8.0
    chain, skip = links(text, tokens)
    unary = np.concatenate([unary, np.zeros((len(skip), unary.shape[1]))])
    p = beliefs(unary, [(i, j, model["chain"]) for i, j in chain] + hubs(len(tokens), skip, model["skip"]))
    best = p.argmax(1)
    more = [(a, int(best[i]) - 1, b) for i, (a, b) in enumerate(tokens) if not known[i] and best[i] and p[i, best[i]] >= least_belief]
    return base, sorted(base + more)


def fitted(docs: DataFrame, most_documents: int, most_nodes: int) -> dict[str, np.ndarray]:
    """The weights. The documents are chosen by their keys first; only theirs are featurised."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                tokens = nodes(text)[:most_nodes]
                chain, skip = links(text, tokens)
                rows.append(repr(([features(text, a, b) for a, b in tokens], labels(tokens, base_spans(text)), chain, skip)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["row"])

    from ast import literal_eval

    own = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text").where(F.col("text").rlike("[0-9@]"))
    keys = own.select("d", "h").distinct().repartition(32).orderBy("d", "h").limit(most_documents).collect()  # 32 times as many keys at most reach the driver
    if not keys:
        return train([])
    few = F.broadcast(docs.sparkSession.createDataFrame([tuple(k) for k in keys], own.select("d", "h").schema).toDF("_d", "_h"))
    chosen = own.join(few, own["d"].eqNullSafe(few["_d"]) & (own["h"] == few["_h"]), "left_semi").dropDuplicates(["d", "h"]).select("text")
    return train([literal_eval(r.row) for r in sorted(chosen.mapInArrow(sample, "row string").collect())])


def scan(docs: DataFrame, most_documents: int = 1_000, most_nodes: int = 50, least_belief: float = 0.9) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and spans for each row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, most_documents, most_nodes))
    spell = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = defaultdict(list)
            for text in batch.column(1):
                base, spans = find(text.as_py() or "", model.value, least_belief)
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
                out["spans"].append(spell(spans))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()]], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span of scan() replaced by its kind in brackets."""
    at = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, 1_000, 50))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    out, to = [], 0
                    for a, k, b in find(text, model.value, 0.9)[1]:
                        if a >= to:
                            out += [text[to:a], mark.format(KINDS[k].upper())]
                        to = max(to, b)
                    text = "".join([*out, text[to:]])
                texts.append(text)
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
