"""Toxicity: a learned lexicon's trie, intersected with Levenshtein automata, and scores of the context of a hit.

The lexicon is learned from labels: whole words, and word beginnings (stems) that stand for all their
endings. The trie and the automaton of `edits` errors are determinised together into one table
state x byte -> state, so all distinct words of a block step through it at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.samples import labelled_sample
from framelake.llm.storage import written
from framelake.llm.textarrays import BLOCK_BYTES, blocks, words

#: Bounds of the fit: labelled documents of either kind, and bytes of the longest.
MAX_TOXIC = 4000
MAX_CLEAN = 12_000
MAX_BYTES = 50_000
STEM = 4
#: Words on either side of a hit that are looked at.
WINDOW = 6
#: Marks that open a quotation with those that close it; one that does both alternates.
QUOTES = (('"', '"'), ("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("»", "«"), ("‘", "’"), ("‚", "‘"), ("'", "'"))
#: Least hits that a context word needs, log odds it must reach to count, and log odds at which a window counts as one of quotation or report.
LEAST_CONTEXT = 5
LEAST_ODDS = 0.7
CLEAN_ODDS = -1.4
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…"


def plain(word: str) -> str:
    """Lower case, without punctuation at its ends."""
    return word.lower().strip(_EDGE)


class Automaton:
    """Deterministic automaton of all strings within the allowed edits of a term (or, for stems, beginning so).

    An edit inserts, drops or replaces a sign, or swaps two neighbours. Terms under `fuzzy_from` characters
    allow none. A state is a set of (trie node, edits used, sign of a swap that must come next); `table` holds
    the next state for each byte of `alphabet` (its last column: any other sign), 0 is dead. `term` and `used` tell which term
    a word matches with the fewest edits if it ends in a state; `final` states of stems take any ending.
    """

    def __init__(self, terms: list[tuple[str, bool]], edits: int = 1, fuzzy_from: int = 5, fuzzy_stems_from: int = 7):
        nodes: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        fuzzy: list[bool] = [False]
        for t, (term, stem) in enumerate(terms):
            at = 0
            soft = len(term) >= (fuzzy_stems_from if stem else fuzzy_from)
            for i, sign in enumerate(term):
                fuzzy[at] |= soft
                if sign not in nodes[at]:
                    nodes[at][sign] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                    fuzzy.append(False)
                at = nodes[at][sign]
            fuzzy[at] |= soft
            ends[at] = t
        self.terms, self.edits = terms, edits
        self.alphabet = {sign: i for i, sign in enumerate(sorted({s for term, _ in terms for s in term}))}
        signs = [*self.alphabet, None]
        soft_end = [e >= 0 and len(terms[e][0]) >= (fuzzy_stems_from if terms[e][1] else fuzzy_from) for e in ends]

        def closed(states: set[tuple[int, int, str]]) -> frozenset:
            """With the errors that skip a sign of the term."""
            todo, out = [x for x in states if not x[2]], set(states)
            while todo:
                node, used, _ = todo.pop()
                if used < edits and fuzzy[node]:
                    for child in nodes[node].values():
                        if fuzzy[child] and (child, used + 1, "") not in out:
                            out.add((child, used + 1, ""))
                            todo.append((child, used + 1, ""))
            return frozenset(x for x in out if x[2] or not any((x[0], u, "") in out for u in range(x[1])))

        def step(states: frozenset, sign: str | None) -> frozenset:
            out: set[tuple[int, int, str]] = set()
            for node, used, wait in states:
                if wait:
                    if sign == wait:
                        out.add((node, used, ""))
                    continue
                stem = ends[node] >= 0 and terms[ends[node]][1]
                if stem and (used == 0 or soft_end[node]):
                    out.add((node, used, ""))  # any ending goes
                if sign in nodes[node]:
                    out.add((nodes[node][sign], used, ""))
                if used < edits and fuzzy[node]:
                    out.add((node, used + 1, ""))
                    for first, child in nodes[node].items():
                        if fuzzy[child]:
                            out.add((child, used + 1, ""))
                            if sign != first and sign in nodes[child] and fuzzy[nodes[child][sign]]:
                                out.add((nodes[child][sign], used + 1, first))
            return closed(out)

        start = closed({(0, 0, "")})
        number, rows = {frozenset(): 0, start: 1}, [[0] * len(signs)]
        order = [start]
        for states in order:
            row = []
            for sign in signs:
                after = step(states, sign)
                if after not in number:
                    number[after] = len(number)
                    order.append(after)
                row.append(number[after])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        best = [min(((used, ends[node]) for node, used, wait in s if not wait and ends[node] >= 0 and (used == 0 or soft_end[node])), default=(-1, -1)) for s in order]
        self.used = np.array([-1, *[u for u, _ in best]], np.int8)
        self.term = np.array([-1, *[t for _, t in best]], np.int32)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Final state of each span of signs (codes of the alphabet); dead ones drop out as they die."""
        state = np.ones(len(starts), np.int32)
        live = np.arange(len(starts))
        at = starts.copy()
        while len(live):
            go = at[live] < ends[live]
            live = live[go]
            state[live] = self.table[state[live], codes[at[live]]]
            live = live[state[live] > 0]
            at[live] += 1
        return state


_ASCII_EDGE = np.zeros(0x110000, bool)
_ASCII_EDGE[[ord(c) for c in _EDGE]] = True


def _encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts and offsets."""
    lowered = [t.lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32), at


_BLANK = np.zeros(0x110000, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def plain_words(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end without outer punctuation, text, and whole start and end of each word of lower-cased texts."""
    blank = _BLANK[points]
    starts, ends, doc = words(np.where(blank, np.uint8(32), np.uint8(97)), at)
    edge = _ASCII_EDGE[points]
    solid = np.flatnonzero(~edge & ~blank)
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends) - 1
    some = a <= b
    left, right = starts.copy(), starts.copy()
    left[some], right[some] = solid[a[some]], solid[b[some]] + 1
    return left, right, doc, starts, ends


def quoted_spans(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each sign of some texts, whether it lies between a mark that opens a quotation and its closing mark.

    Marks between two letters or digits are apostrophes. A pair lies in one line of one text; of marks of
    one style an opening one goes with the next mark if that closes.
    """
    line = np.cumsum((points == 10) | np.isin(np.arange(len(points)), at[1:-1])) if len(points) else np.zeros(0, np.int64)
    solid = ~_ASCII_EDGE[points] & ~_BLANK[points]
    inner = np.zeros(len(points), bool)
    inner[1:-1] = solid[:-2] & solid[2:] & (line[:-2] == line[1:-1]) & (line[2:] == line[1:-1])
    depth = np.zeros(len(points) + 1, np.int64)
    for opens, closes in QUOTES:
        places = np.flatnonzero(((points == ord(opens)) | (points == ord(closes))) & ~inner)
        if opens == closes:
            order = np.arange(len(places)) - np.searchsorted(line[places], line[places])  # its number in the line
            first = np.flatnonzero(order[:-1] % 2 == 0) if len(places) else places
        else:
            leads = points[places[np.searchsorted(line[places], line[places])]] == ord(opens)  # whether the line's first mark of the style opens
            first = np.flatnonzero((points[places[:-1]] == ord(opens)) & (points[places[1:]] == ord(closes)) & leads[:-1]) if len(places) else places
        first = first[line[places[first]] == line[places[first + 1]]]
        np.add.at(depth, places[first] + 1, 1)
        np.add.at(depth, places[first + 1], -1)
    return np.cumsum(depth)[:-1] > 0


def hits(texts: list[str], automaton: Automaton, context: dict[str, float] | None = None) -> dict[str, np.ndarray | list]:
    """Every word that the automaton accepts: text, term, edits, whether its context is one of quotation, words around it.

    That is so between quotation marks, or where the learned log odds (`context`) of the words around add
    up to CLEAN_ODDS or less. Window words are given only where no context is.
    """
    points, at = _encoded(texts)
    left, right, doc, _, _ = plain_words(points, at)
    codes = np.full(0x110000, len(automaton.alphabet), np.int32)
    for sign, i in automaton.alphabet.items():
        codes[ord(sign)] = i
    state = automaton.match(codes[points], left, right)
    found = np.flatnonzero((automaton.term[state] >= 0) & (right > left))
    between = quoted_spans(points, at)[left[found]] if len(found) else np.zeros(0, bool)
    first = np.searchsorted(doc, doc[found])
    last = np.searchsorted(doc, doc[found], "right")
    a, b = np.maximum(found - WINDOW, first), np.minimum(found + WINDOW + 1, last)
    around, odds = [], np.zeros(len(found))
    if context is None or context:
        for i, (x, y, own) in enumerate(zip(a.tolist(), b.tolist(), found.tolist(), strict=True)):
            near = {points[left[w] : right[w]].tobytes().decode("utf-32-le", "replace") for w in range(x, y) if w != own}
            if context is None:
                around.append(sorted(near))
            else:
                odds[i] = sum(context.get(w, 0.0) for w in near)
    return {"doc": doc[found], "term": automaton.term[state[found]], "used": automaton.used[state[found]], "quoted": between | (odds <= CLEAN_ODDS), "around": around}


def _terms(text: str) -> set[str]:
    own = {w for w in map(plain, text.split()) if len(w) >= 3 and "*" not in w}
    return own | {w[:k] + "*" for w in own for k in range(STEM, len(w))}


def _unquoted(text: str) -> str:
    """A lower-cased text with quotations blanked."""
    points, at = _encoded([text])
    return np.where(quoted_spans(points, at), np.uint32(32), points).astype(np.uint32).tobytes().decode("utf-32-le", "replace")


def _counted(rows: DataFrame, allowed=None) -> DataFrame:
    """(term, n) distinct texts that hold each word or stem; of those allowed, if given, texts that hold it outside quotations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = _terms(text) if allowed is None else _terms(_unquoted(text)) & allowed.value
                yield pa.record_batch([pa.array(sorted(own), pa.string())], ["term"])

    return rows.select("text").mapInArrow(run, "term string").groupBy("term").agg(F.count("*").alias("n"))


def learn_lexicon(sample: DataFrame, scale: float, least_docs: int = 3, least_share: float = 0.9) -> list[tuple[str, bool]]:
    """Terms (and whether a stem) that mark toxic texts of a bounded sample(text, label) of distinct texts.

    Candidates are the words and stems of at least `least_docs` toxic texts;
    those kept have `least_share` of their texts toxic, each other text counting `scale` times, if
    it doesn't merely quote them. A greedy
    cover of the toxic texts then takes the terms that add most; each must add `least_docs` that no earlier
    one covers, so words that merely stand beside others drop out.
    """
    spark = sample.sparkSession
    toxic = sample.where("label = 1")
    found = _counted(toxic).where(F.col("n") >= least_docs).collect()  # of the bounded sample
    bad = {r["term"]: r["n"] for r in found}
    clean = {r["term"]: r["n"] for r in _counted(sample.where("label = 0"), spark.sparkContext.broadcast(frozenset(bad))).collect()}
    held = spark.sparkContext.broadcast(frozenset(t for t, n in bad.items() if n >= least_share * (n + scale * clean.get(t, 0))))

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([sorted(_terms(t) & held.value) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["terms"])

    texts = [set(r["terms"]) for r in toxic.select("text").mapInArrow(of_text, "terms array<string>").collect()]
    where: dict[str, set[int]] = {}
    for i, terms in enumerate(texts):
        for t in terms:
            where.setdefault(t, set()).add(i)
    chosen: list[tuple[str, bool]] = []
    while where:
        # most documents first; of equal ones a whole word, then the longer
        best = max(where, key=lambda t: (len(where[t]), not t.endswith("*"), len(t), t))
        covered = where.pop(best)
        if len(covered) < least_docs:
            break
        chosen.append((best.removesuffix("*"), best.endswith("*")))
        word = best.removesuffix("*")
        for t in list(where):
            inside = t.startswith(word) and best.endswith("*")
            # whole words may share documents: each new one needs enough of its own; extensions of a stem go
            if inside or word.startswith(t.removesuffix("*")):
                del where[t]
            elif len(where[t] - covered) < max(least_docs, 0.2 * len(where[t])):
                del where[t]
    return chosen


def learned_context(found: DataFrame, scale: float) -> dict[str, float]:
    """Log odds of toxic against other texts for the words around exact hits of found(around, toxic), those that tell them apart."""
    bad, good = (F.sum(F.when(F.col("toxic") == v, 1).otherwise(0)) for v in (1, 0))
    total = found.agg(bad.alias("bad"), good.alias("good")).first()
    n_bad, n_good = total["bad"] or 0, (total["good"] or 0) * scale
    words_ = found.select("toxic", F.explode("around").alias("word")).groupBy("word").agg(bad.alias("bad"), good.alias("good")).where(F.col("bad") + F.col("good") >= LEAST_CONTEXT)
    odds = {r["word"]: float(np.log((r["bad"] + 1) / (n_bad + 2)) - np.log((r["good"] * scale + 1) / (n_good + 2))) for r in words_.collect()}  # of the bounded sample
    return {w: x for w, x in odds.items() if w and abs(x) >= LEAST_ODDS} if n_bad and n_good else {}


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> dict:
    """The lexicon, the words that speak for quotation or abuse, and for each term, number of edits and context the share of toxic texts among those hit.

    Fitted on bounded samples of docs(doc_id, text) with labels(doc_id, label); texts that are equal count once.
    A share is drawn towards that of all terms with as many edits in such a context (worth four texts), which is
    itself drawn towards the one for exact hits, or, in quotation, towards a half (worth two texts each).
    """
    total = {r["label"]: r["n"] for r in labels.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = max(1.0, total.get(0, 0) / max_clean)
    sample = labelled_sample(docs, labels, {1: max_toxic, 0: max_clean}, max_bytes).dropDuplicates(["text", "label"])
    sample = written(sample, "labelled")
    terms = learn_lexicon(sample, scale)
    if not terms:
        return {"terms": [], "weight": {}, "context": {}}
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(terms))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = hits([t or "" for t in batch.column(0).to_pylist()], automaton.value)
            exact = np.flatnonzero(got["used"] == 0)
            yield pa.record_batch([batch.column(1).take(pa.array(got["doc"][exact])), pa.array([got["around"][i] for i in exact], pa.list_(pa.string()))], ["toxic", "around"])

    context = learned_context(sample.select("text", "label").mapInArrow(around, "toxic int, around array<string>"), scale)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = hits([t or "" for t in batch.column(0).to_pylist()], automaton.value, context)
            rows = np.unique(np.stack([got["doc"], got["term"], got["used"], got["quoted"]]).astype(np.int64), axis=1)
            yield pa.record_batch([pa.array(rows[1].astype(np.int32)), pa.array(rows[2].astype(np.int32)), pa.array(rows[3] > 0), batch.column(1).take(pa.array(rows[0]))], ["term", "used", "quoted", "toxic"])

    table = sample.select("text", "label").mapInArrow(kinds, "term int, used int, quoted boolean, toxic int").groupBy("term", "used", "quoted").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()
    counts = {(r["term"], r["used"], r["quoted"]): (r["bad"], r["bad"] + scale * (r["n"] - r["bad"])) for r in table}
    pooled = lambda used, quoted: [sum(counts.get((t, used, quoted), (0, 0))[i] for t in range(len(terms))) for i in (0, 1)]
    share: dict[tuple[int, bool], float] = {}
    for used, quoted in ((0, False), (1, False), (0, True), (1, True)):
        bad, n = pooled(used, quoted)
        towards = 0.5 if quoted or not used else share[0, False]
        share[used, quoted] = (bad + 2 * towards) / (n + 2)
    weight = {}
    for t in range(len(terms)):
        for used, quoted in share:
            bad, n = counts.get((t, used, quoted), (0, 0))
            weight[t, used, quoted] = (bad + 4 * share[used, quoted]) / (n + 4)
    return {"terms": terms, "weight": weight, "context": context}


def scored_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """docs(row, text) as (row, score, n_hits): one minus the product of what each distinct hit leaves open."""
    terms = model["terms"]
    weight = np.zeros((max(1, len(terms)), 2, 2))
    for (t, used, quoted), w in model["weight"].items():
        weight[t, used, int(quoted)] = w
    held = docs.sparkSession.sparkContext.broadcast((Automaton(terms) if terms else None, weight, model["context"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table, context = held.value
        for batch in batches:
            score, n_hits = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            if automaton is not None:
                for first, end, _, _ in blocks(batch.column(1), BLOCK_BYTES // 2):
                    got = hits([t or "" for t in batch.column(1).slice(first, end - first).to_pylist()], automaton, context)
                    kinds = np.unique(np.stack([got["doc"], got["term"], got["used"], got["quoted"]]).astype(np.int64), axis=1)
                    open_ = np.log1p(-np.minimum(table[kinds[1], kinds[2], kinds[3]], 1 - 1e-9))
                    score[first:end] = 1 - np.exp(np.bincount(kinds[0], open_, end - first))
                    n_hits[first:end] = np.bincount(got["doc"], minlength=end - first)
            yield pa.record_batch([batch.column(0), pa.array(np.clip(score, 0.0, 1.0)), pa.array(n_hits)], ["row", "score", "n_hits"])

    return docs.select("row", "text").mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, score double, n_hits long")


def document_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) for every row of documents.

    Learns labels.toxic from rows whose crc32(doc_id) mod 3 is not 1 (null doc_id: held out). Null and
    empty texts and texts without a hit score 0; repeated rows stay and score alike; of labels that disagree
    the larger counts; without labels, or without a term that marks toxic texts, every score is 0.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col("toxic").alias("label"))
    model = fit_toxicity(docs, known)
    scores = scored_toxicity(rows.select(F.struct("doc_id", "held_out").alias("row"), "text"), model)
    return scores.select("row.doc_id", "row.held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
