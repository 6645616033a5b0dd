"""Scoring texts by a class-based bigram model (Brown clustering by exchange).

P(w | v) = P(class of w | class of v) * P(w | class of w), smoothed. A text's
score is the log10 probability of its words and of the end after them.

1. Counts of all words of the training texts, as 64-bit hashes with a sum.
2. The `core` most frequent words (a fixed number) are clustered by exchange: from
   bigram counts among them, each word in turn moves to the class that raises the
   likelihood of the class bigrams most, until few move. Classes are clustered
   again, by the same rule, into a few groups.
3. Each other word goes to one of these classes by the same gain, from counts of
   the classes before and after it, with all words but itself where they are
   after step 2 (words outside the core as one kind).
4. Texts get their words' classes and counts in chunks of bounded size. The
   distinct words of a chunk look them up by a join, so a word of the corpus is
   looked up once in a chunk and not once an occurrence, and no table that grows
   with the vocabulary is broadcast. Class transitions are counted over all
   training texts from these classes, and texts are scored from them.

Smoothing: transitions are interpolated with class frequencies; half a count of
each word seen once is held back in its class for unknown words (one type);
after unknown words stands what one of the group of the last known word's class
would be; the result is mixed with the base model. Probabilities over the V words of the
training texts and the unknown word sum to 1 after every history.

Defined cases: null text is empty and scores as its end alone; a null id is held
out or not by the checksum of the empty string; repeated rows count and score
once each; with no training texts all scores come from the base model's
formula over no counts; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import stored, text_or_empty
from concord.llm.wordhash import slices, text_buffers, word_hashes

#: The hash that stands for the end of a text.
END = -(1 << 63)
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))


def _tokens(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and, after each text's words, its end; and the text of each."""
    words, owner = word_hashes(batch.column(column))
    n = batch.num_rows
    at = np.searchsorted(owner, np.arange(n), "right")
    return np.insert(words.view(np.int64), at, END), np.insert(owner, at, np.arange(n))


def _emit(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


class _Counts:
    """Counts of 64-bit codes, summed in memory up to a bound."""

    def __init__(self, most: int = 2_000_000):
        self.codes, self.counts, self.held, self.most = [], [], 0, most

    def add(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        code, n = np.unique(codes, return_counts=True)
        self.codes.append(code)
        self.counts.append(n)
        self.held += len(code)
        if self.held > self.most:
            code, n = _merge(self.codes, self.counts)
            if len(code) > self.most // 2:
                self.codes, self.counts, self.held = [], [], 0
                return code, n
            self.codes, self.counts, self.held = [code], [n], len(code)
        return None

    def rest(self) -> tuple[np.ndarray, np.ndarray] | None:
        return _merge(self.codes, self.counts) if self.codes else None


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash) and n, over texts (doc_id, held_out, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Counts()
        for batch in batches:
            for some in slices(batch, 2):
                if full := total.add(_tokens(some, 2)[0]):
                    yield _emit(["word", "n"], *full)
        if full := total.rest():
            yield _emit(["word", "n"], *full)

    return texts.mapInArrow(read, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(words: np.ndarray, core: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each word in the core, len(core) for others, len(core) + 1 for the end; core ascending, order: places."""
    k = np.minimum(np.searchsorted(core, words), max(len(core) - 1, 0))
    found = order[k] if len(core) else np.zeros(len(words), np.int64)
    return np.where(words == END, len(core) + 1, np.where((core[k] == words) if len(core) else False, found, len(core)))


def bigrams(texts: DataFrame, core: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Counts of neighbours among core words, others (one kind) and ends: a matrix of fixed size."""
    n = len(core) + 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Counts()
        for batch in batches:
            for some in slices(batch, 2):
                ids = _ids(_tokens(some, 2)[0], core, order)
                before = np.concatenate([[n - 1], ids[:-1]])  # the end of the text before, too
                if full := total.add(before * n + ids):
                    yield _emit(["code", "n"], *full)
        if full := total.rest():
            yield _emit(["code", "n"], *full)

    rows = texts.mapInArrow(read, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # n * n rows at most
    out = np.zeros(n * n)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def exchange(counts: np.ndarray, classes: int, fixed: int = 0, passes: int = 6) -> np.ndarray:
    """The class of each item: moves of single items that raise the likelihood of class bigrams, until under 1 % move.

    The last `fixed` items keep classes of their own, after the others.
    """
    n, free = len(counts), len(counts) - fixed
    own = np.concatenate([np.arange(free) % classes, classes + np.arange(fixed)])
    k = classes + fixed
    member = np.zeros((n, k))
    member[np.arange(n), own] = 1
    right, left = counts @ member, counts.T @ member  # of each item, by the other's class
    pairs = member.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(passes):
        moved = 0
        for w in range(free):
            a, self_ = own[w], counts[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= self_
            c[a] -= self_
            pairs[a] -= r
            pairs[:, a] -= c
            pairs[a, a] -= self_
            # the word's neighbours count for their own classes wherever it goes
            rows, cols = pairs.sum(axis=1) + c, pairs.sum(axis=0) + r
            gain = (f(pairs + r) - f(pairs)).sum(axis=1) + (f(pairs + c[:, None]) - f(pairs)).sum(axis=0)
            inner = np.diag(pairs)
            gain += f(inner + r + c + self_) - f(inner + r) - f(inner + c) + f(inner)
            r_sum, c_sum = r.sum() + self_, c.sum() + self_
            gain -= f(rows + r_sum) - f(rows) + f(cols + c_sum) - f(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += r
            pairs[:, b] += c
            pairs[b, b] += self_
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                left[:, a] -= counts[w]
                left[:, b] += counts[w]
        if moved <= free // 100:
            break
    return own


def gains(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the likelihood of class bigrams gains, by class, where one word of the other words moves there; a row per word.

    pairs: bigrams of classes, with other words and the end last. counts: of each
    word, what stands before it by class, what stands after it, and itself after
    itself, which is in neither. The part that all classes share is left out.
    """
    k = len(pairs)
    free, other = k - 2, k - 2
    before, after, self_ = counts[:, :k], counts[:, k : 2 * k], counts[:, 2 * k :]

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    out = np.zeros((len(counts), free))
    for found, table in ((after, pairs[:free].T), (before, pairs[:, :free])):
        found = found.copy()
        found[:, other] = 0
        word, slot = np.nonzero(found)
        if len(word):
            held = table[slot]
            parts = f(held + found[word, slot][:, None]) - f(held)
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[begins]] += np.add.reduceat(parts, begins)
    # the word's neighbours lose it as one of the other words
    b, a = before[:, :free], after[:, :free]
    for lost, table, found in ((b, pairs[:free, other], after), (a, pairs[other, :free], before)):
        held = table - lost
        out += f(held + found[:, other : other + 1]) - f(held)
    word, own = np.nonzero((a > 0) & (b > 0) | (self_ > 0))
    inner, r, c = np.diag(pairs)[own], a[word, own], b[word, own]
    out[word, own] += f(inner + r + c + self_[word, 0]) - f(inner + r) - f(inner + c) + f(inner)
    for total, found in ((pairs.sum(axis=1)[:free], after), (pairs.sum(axis=0)[:free], before)):
        out -= f(total + found.sum(axis=1, keepdims=True) + self_) - f(total)
    return out


def _beside(texts: DataFrame, ascending: np.ndarray, order: np.ndarray, own: np.ndarray, k: int, most: int = 2_000_000) -> DataFrame:
    """word and seen, for words outside the core: its neighbours by class, as 32-bit numbers of place (10 bits) and count."""
    kinds = own.astype(np.int16)  # of the core, other words and the end

    def packed(words: list[np.ndarray], places: list[np.ndarray]) -> pa.RecordBatch:
        word, where = np.unique(np.concatenate(words), return_inverse=True)
        code, n = np.unique(where * 1024 + np.concatenate(places), return_counts=True)
        at = np.append(np.flatnonzero(np.diff(code >> 10, prepend=-1)), len(code)).astype(np.int32) * 4
        entries = ((code & 1023) << 22 | n).astype(np.uint32)
        seen = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(at), pa.py_buffer(entries)])
        return pa.RecordBatch.from_arrays([pa.array(word), seen], names=["word", "seen"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, places, held = [], [], 0
        for batch in batches:
            for some in slices(batch, 2):
                tokens, _ = _tokens(some, 2)
                kind = kinds[_ids(tokens, ascending, order)]
                at = np.flatnonzero(kind == k - 2)  # never the last: that is an end
                word, before, after = tokens[at], np.concatenate([[k - 1], kind[:-1]])[at], kind[at + 1] + k
                after[tokens[at + 1] == word] = 2 * k
                first = (at == 0) | (tokens[at - 1] != word)
                words += [word[first], word]
                places += [before[first].astype(np.int16), after.astype(np.int16)]
                held += 2 * len(word)
                if held > most:  # counts have 22 bits
                    yield packed(words, places)
                    words, places, held = [], [], 0
        if held:
            yield packed(words, places)

    return texts.mapInArrow(read, "word bigint, seen binary")


def assigned(texts: DataFrame, ascending: np.ndarray, order: np.ndarray, own: np.ndarray, between: np.ndarray) -> DataFrame:
    """word, n and cls of the words outside the core: each in the class of the largest gain, the others' as they are."""
    k = len(between)

    def best(words: np.ndarray, owner: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
        size = 2 * k + 1
        code = owner * size + (entries >> np.uint32(22)).astype(np.int64)
        counts = np.bincount(code, weights=(entries & np.uint32((1 << 22) - 1)).astype(np.float64), minlength=len(words) * size).reshape(-1, size)
        cls = np.concatenate([gains(between, counts[lo : lo + 1024]).argmax(axis=1) for lo in range(0, len(words), 1024)])
        n = counts[:, :k].sum(axis=1) + counts[:, 2 * k]
        return _emit(["word", "n", "cls"], words, n.astype(np.int64), cls.astype(np.int32))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, kept = np.zeros(0, np.int64), np.zeros(0, np.uint32)  # rows of the last word, which may go on
        lengths = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = text_buffers(batch.column(1))
            words = np.concatenate([rest, batch.column(0).to_numpy()])
            entries = np.concatenate([kept, data.view(np.uint32)])
            lengths = np.concatenate([lengths, np.diff(at) // 4])
            begins = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            cut = begins[-1]
            where = int(lengths[:cut].sum())
            if cut:
                owner = np.repeat(np.arange(len(begins) - 1), np.add.reduceat(lengths[:cut], begins[:-1]))
                yield best(words[begins[:-1]], owner, entries[:where])
            rest, kept, lengths = words[cut:], entries[where:], lengths[cut:]
        if len(rest):
            yield best(rest[:1], np.zeros(len(kept), np.int64), kept)

    beside = _beside(texts, ascending, order, own, k)
    return beside.repartition("word").sortWithinPartitions("word").mapInArrow(read, "word bigint, n bigint, cls int")


def score(docs: DataFrame, core: int = 2048, classes: int = 64, groups: int = 8, mixture: float = 0.9, chunk: int = 24 << 20) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; of at most 509 classes."""
    if not 0 < classes <= 509:
        raise ValueError("from 1 to 509 classes: places beside a word are coded in 10 bits")
    spark = docs.sparkSession
    texts = _texts(docs)
    train = texts.where(~F.col("held_out"))
    vocabulary = stored(word_counts(train), "words")
    totals = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends")).head()
    n_train, n_types, n_ends = int(totals["n"] or 0), int(totals["v"]), int(totals["ends"] or 0)

    top = vocabulary.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(core).collect()
    words = np.array([r["word"] for r in top], np.int64)
    order = np.argsort(words)
    ascending = words[order]
    counts = bigrams(train, ascending, order)
    own = exchange(counts, classes, fixed=2)
    member = np.zeros((len(own), classes + 2))
    member[np.arange(len(own)), own] = 1
    between = member.T @ counts @ member
    #: classes: of words, and the end; then what stands for an unknown word after a group of classes
    k, end = classes + 1, classes
    group = np.append(exchange(between[: classes + 1, : classes + 1], groups, fixed=1)[:classes], groups)

    fixed = [(int(r["word"]), int(r["n"]), int(c)) for r, c in zip(top, own, strict=False)] + ([(END, n_ends, end)] if n_ends else [])
    lexicon = assigned(train, ascending, order, own, between).unionByName(spark.createDataFrame(fixed, "word bigint, n bigint, cls int"))
    lexicon = stored(lexicon, "lexicon")
    sizes = lexicon.groupBy("cls").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).toPandas()  # k rows at most
    size, once = np.zeros(k), np.zeros(k)
    size[sizes["cls"].to_numpy(int)], once[sizes["cls"].to_numpy(int)] = sizes["n"].to_numpy(float), sizes["once"].to_numpy(float)
    once[end] = 0
    share = (size / size.sum()) if size.sum() else np.full(k, 1 / k)
    with np.errstate(divide="ignore", invalid="ignore"):
        unseen = np.where(size > 0, 0.5 * once / size, 1.0)
    log_base = np.log10(n_train + 0.5 * (n_types + 1))
    cls_type, n_type = np.dtype(np.uint8 if k < 255 else np.uint16), np.dtype(np.uint32 if n_train < 1 << 32 else np.uint64)
    unknown_word = np.iinfo(cls_type).max

    bytes_ = texts.agg(F.avg(F.octet_length("text"))).head()[0] or 1.0
    rows_each = max(1, int(chunk / max(bytes_, 1.0)))
    # runs of rows of a partition, which a task that runs again finds the same
    place_ = F.monotonically_increasing_id()
    run = F.floor(place_.bitwiseAND(F.lit((1 << 33) - 1)) / rows_each)
    dealt = texts.withColumn("chunk", (F.shiftright(place_, 33) * (1 << 24) + run).cast("bigint"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        held_ = 0
        for batch in batches:
            for some in slices(batch, 2):
                tokens, owner = _tokens(some, 2)
                of = some.column(3).to_numpy()[owner]
                by = np.argsort(of, kind="stable")
                cut = np.flatnonzero(np.diff(of[by])) + 1
                for part in np.split(by, cut):
                    words_ = np.unique(tokens[part])
                    seen.setdefault(int(of[part[0]]), []).append(words_)
                    held_ += len(words_)
                if held_ > 4_000_000:
                    for c, parts in seen.items():
                        words_ = np.unique(np.concatenate(parts))
                        yield _emit(["chunk", "word"], np.full(len(words_), c), words_)
                    seen, held_ = {}, 0
        for c, parts in seen.items():
            words_ = np.unique(np.concatenate(parts))
            yield _emit(["chunk", "word"], np.full(len(words_), c), words_)

    asked = dealt.mapInArrow(distinct, "chunk bigint, word bigint")
    answers = asked.join(lexicon, "word").select("chunk", "word", "n", "cls")

    def coded(left: pa.Table, right: pa.Table) -> pa.Table:
        """The class and count of each token, as bytes."""
        known_words = right.column("word").to_numpy()
        by = np.argsort(known_words)
        known_words, known_n, known_cls = known_words[by], right.column("n").to_numpy()[by], right.column("cls").to_numpy()[by]
        out = []
        for batch in left.to_batches():
            for some in slices(batch, 2):
                tokens, owner = _tokens(some, 2)
                at = np.minimum(np.searchsorted(known_words, tokens), max(len(known_words) - 1, 0))
                hit = (known_words[at] == tokens) if len(known_words) else np.zeros(len(tokens), bool)
                n = np.where(hit, known_n[at] if len(known_words) else 0, 0).astype(n_type)
                cls = np.where(hit, known_cls[at] if len(known_words) else 0, unknown_word).astype(cls_type)
                begins = np.searchsorted(owner, np.arange(some.num_rows + 1)).astype(np.int32)
                held = [pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer(begins * x.itemsize), pa.py_buffer(x)]) for x in (cls, n)]
                out.append(pa.RecordBatch.from_arrays([some.column(0), some.column(1), *held], schema=coded_schema))
        return pa.Table.from_batches(out, coded_schema)

    coded_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("classes", pa.binary()), ("counts", pa.binary())])
    both = dealt.select("doc_id", "held_out", "text", "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    codes = stored(both.applyInArrow(coded, "doc_id bigint, held_out boolean, classes binary, counts binary"), "codes")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros(k * k, np.int64)
        for batch in batches:
            for some in slices(batch, 0):
                cls = text_buffers(some.column(0))[0].view(cls_type).astype(np.int64)
                links += np.bincount(np.concatenate([[end], cls[:-1]]) * k + cls, minlength=k * k)
        at = np.flatnonzero(links)
        yield _emit(["code", "n"], at, links[at])

    rows = codes.where(~F.col("held_out")).select("classes").mapInArrow(follow, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # k * k rows at most
    moves = np.zeros(k * k)
    moves[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    moves = moves.reshape(k, k)
    moves = (moves + 10 * share) / (moves.sum(axis=1, keepdims=True) + 10)
    # after unknown words: the classes of one that follows the group of the last known word
    unknown_cls = np.zeros((groups + 1, k))
    np.add.at(unknown_cls, group, np.maximum(size, 1e-9)[:, None] * moves * unseen)
    sums = unknown_cls.sum(axis=1, keepdims=True)
    unknown_cls = np.where(sums > 0, unknown_cls / np.where(sums > 0, sums, 1), share)
    moves = np.concatenate([moves, unknown_cls @ moves])
    unknown = moves @ unseen

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2, 1 << 18):
                stored_cls, at = text_buffers(some.column(2))
                cls = stored_cls.view(cls_type).astype(np.int64)
                n = text_buffers(some.column(3))[0].view(n_type).astype(np.float64)
                begins = at[:-1] // cls_type.itemsize
                hit = cls != unknown_word
                cls = np.where(hit, cls, 0)
                base = np.log10(n + 0.5) - log_base
                last = np.maximum.accumulate(np.where(hit, np.arange(len(cls)), -1))
                state = np.where(last >= 0, cls[np.maximum(last, 0)], end)
                state = np.where(hit, state, k + group[state])
                before = np.concatenate([[end], state[:-1]])
                emitted = (n - 0.5 * ((n == 1) & (cls != end))) / np.maximum(size[cls], 1)
                model = np.where(hit, moves[before, cls] * emitted, unknown[before])
                mixed = np.log10(mixture * model + (1 - mixture) * 10.0**base) if n_train else base
                add = lambda x: np.add.reduceat(x, begins)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.diff(at) // cls_type.itemsize), pa.array(add(hit.astype(np.int64))), pa.array(np.full(some.num_rows, n_train)), pa.array(add(base)), pa.array(add(mixed))],
                    names=[x.split(" ")[0] for x in SCORES.split(", ")],
                )

    return codes.mapInArrow(apply, SCORES)
