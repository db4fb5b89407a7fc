"""Searches for many source verses at once: every row of a table of sources against the whole corpus.

sources: (source_id), ids of verses of the corpus, each once. Results name a pair by source_id and id;
what a source gets is what the single search of operators.related gives it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappush, heappushpop
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import blocks, forms, pairs, text
from ..plans.config import ScoringConfig
from ..plans.storage import staged
from ..sources.corpus import REFERENCE, Corpus, in_testament
from .related import EXPLANATION, FIELDS, LAYER, rank_key
from .second import Second
from .workflows import evidence_types

#: Sources that are held at a time by a scan of the targets, rows of a batch that goes out, targets of a block that sources are ranked over.
BLOCK, ROWS, TARGETS = 256, 20_000, 8192
PAIR = "source_id bigint, id bigint, source_label string, label string"
#: How far sums in another order may be apart.
MARGIN = 2e-6

#: Of a block of targets: what gives the columns of the pairs with a source, after the places of its targets.
Kernel = Callable[[blocks.Block], Callable[[dict], tuple[np.ndarray, ...]]]


def _read(files: list[str], rows: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of staged files."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    for file in files:
        fs, path = FileSystem.from_uri(file)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)


def _pairs(corpus: Corpus, sources: DataFrame, fields: list[str], layer: str, kernel: Kernel, columns: str, targets: DataFrame | None = None) -> DataFrame:
    """PAIR rows with what a kernel finds of each source and the targets of a block.

    Feature rows of the sources are staged in the shared folder. A task reads them in blocks for each
    batch of its targets, so that no task and no driver holds all sources; a pair is met once, and
    nothing but the targets is shuffled.
    """
    picked = ["id", "label", *fields]
    files = staged(corpus.features.join(sources, F.col("id") == F.col("source_id")).select(*picked)).inputFiles()
    kind = f"{PAIR}, {columns}" if columns else PAIR
    schema = to_arrow_schema(corpus.spark.createDataFrame([], kind).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = blocks.Block(batch, layer)
            meet, labels = kernel(block), batch.column(1)
            out: list[list[pa.Array]] = [[] for _ in schema.names]
            size = 0
            for source in chain.from_iterable(part.to_pylist() for part in _read(files, BLOCK)):
                rows, *found = meet(source)
                kept = block.ids[rows] != source["id"]
                if not kept.all():
                    rows, found = rows[kept], [x[kept] for x in found]
                if not len(rows):
                    continue
                same = [pa.repeat(pa.scalar(source[c], kind), len(rows)) for c, kind in (("id", pa.int64()), ("label", pa.string()))]
                row = [same[0], pa.array(block.ids[rows]), same[1], labels.take(pa.array(rows)), *(pa.array(x, f.type) for x, f in zip(found, list(schema)[4:]))]
                for column, part in zip(out, row):
                    column.append(part)
                size += len(rows)
                if size >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], schema=schema)
                    out, size = [[] for _ in schema.names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], schema=schema)

    rows = (corpus.features if targets is None else targets).select(*picked)
    return rows.repartition(4 * corpus.spark.sparkContext.defaultParallelism).mapInArrow(run, kind)


def candidates(corpus: Corpus, sources: DataFrame, level: str = "exact_spelling") -> DataFrame:
    """PAIR rows: verses other than the source with a token of it."""
    layer = LAYER[level]

    def kernel(block: blocks.Block):
        def meet(source: dict) -> tuple[np.ndarray, ...]:
            met = np.zeros(block.size, bool)
            for word in set(source[layer]):
                met[block.rows[block.of(word)]] = True
            return (np.flatnonzero(met),)

        return meet

    return _pairs(corpus, sources, [layer], layer, kernel, "")


def _overlap(corpus: Corpus, sources: DataFrame, config: ScoringConfig, columns: str, testament: str | None = None) -> DataFrame:
    """PAIR rows with shared, jaccard and rare, as far as columns name them; sums are taken in the order of the words."""
    layer, (n, rare_threshold) = LAYER[config.match_level], corpus.size_and_threshold
    wanted = [c.split()[0] for c in columns.split(", ")]

    def kernel(block: blocks.Block):
        sums = Overlap(block, config, n, rare_threshold)

        def meet(source: dict) -> tuple[np.ndarray, ...]:
            rows, shared, jaccard, rare = sums.of(_words(source, layer, config, n))
            found = {"shared": shared, "jaccard": blocks.round6(jaccard), "rare": blocks.round6(rare)}
            return rows, *(found[c] for c in wanted)

        return meet

    targets = corpus.features.where(in_testament(testament))
    return _pairs(corpus, sources, list(dict.fromkeys([layer, "normalized", "df"])), layer, kernel, columns, targets)


def _words(source: dict, layer: str, config: ScoringConfig, n: int) -> list[tuple[str, float, float, int]]:
    """(word, weight, idf, document frequency) of a source's words in their order."""
    of = {w: (d, config.token_multipliers.get(norm, 1)) for w, norm, d in zip(source[layer], source["normalized"], source["df"])}
    return [(w, (x := float(blocks.idf(d, n))) * m, x, d) for w, (d, m) in sorted(of.items())]


class Overlap:
    """Weighted overlap and rarity of sources with the targets of a block."""

    def __init__(self, block: blocks.Block, config: ScoringConfig, n: int, rare_threshold: int):
        self.block, self.config, self.rare_threshold = block, config, rare_threshold
        weight = blocks.idf(block.flat("df")[block.at], n)
        if config.token_multipliers:
            norms = block.flat("normalized")[block.at]
            weight = weight * np.array([config.token_multipliers.get(w, 1) for w in norms])
        self.total = block.totals(weight)

    def of(self, words: list[tuple[str, float, float, int]]) -> tuple[np.ndarray, ...]:
        """(rows that share a word, shared words, jaccard, rare), unrounded."""
        common, rare, shared = np.zeros(self.block.size), np.zeros(self.block.size), np.zeros(self.block.size, np.int32)
        own = 0.0
        for word, weight, idf, df in words:
            rows = self.block.rows[self.block.of(word)]
            common[rows] += weight
            shared[rows] += 1
            own += weight
            if df <= self.rare_threshold:
                rare[rows] += idf
        rows = np.flatnonzero(shared)
        union = self.total[rows] + own - common[rows]
        jaccard = np.divide(common[rows], union, out=np.zeros(len(rows)), where=union != 0)
        return rows, shared[rows], np.clip(jaccard, 0, 1), np.clip(rare[rows] / self.config.rare_cap, 0, 1)


def weighted_overlap(corpus: Corpus, sources: DataFrame, level: str = "exact_spelling") -> DataFrame:
    """PAIR rows with shared and jaccard: weighted Jaccard of every candidate."""
    return _overlap(corpus, sources, ScoringConfig(level), "shared int, jaccard double")


def components(corpus: Corpus, sources: DataFrame, testament: str | None = None, config: ScoringConfig | None = None) -> DataFrame:
    """PAIR rows with shared, jaccard and rare: weighted overlap and rarity of every candidate of each source."""
    return _overlap(corpus, sources, config or ScoringConfig(), "shared int, jaccard double, rare double", testament)


def phrase_runs(corpus: Corpus, sources: DataFrame, least: int = 3) -> DataFrame:
    """PAIR rows with source_start, target_start and length: maximal common runs of each source with every other verse."""

    def kernel(block: blocks.Block):
        grams = blocks.Grams(block, least)

        def meet(source: dict) -> tuple[np.ndarray, ...]:
            start, at, length = grams.runs(block.numbered(source["folded"]))
            rows = block.row[at]
            return rows, start, at - block.first[rows], length

        return meet

    return _pairs(corpus, sources, ["folded"], "folded", kernel, "source_start int, target_start int, length bigint")


def weighted_dice(corpus: Corpus, sources: DataFrame) -> DataFrame:
    """PAIR rows with dice: twice the common weight by the sum of weights, as second.weighted_dice has it."""
    most = corpus.statistics.agg(F.max(text.letters(F.col("normalized")))).first()[0]  # apostrophes aren't letters

    def kernel(block: blocks.Block):
        value = np.array([forms.word_length_value(w, most) for w in block.words], float)
        q = value[block.word] * block.times
        total = block.totals(q)

        def meet(source: dict) -> tuple[np.ndarray, ...]:
            common, met = np.zeros(block.size), np.zeros(block.size, bool)
            words: dict[str, int] = {}
            for w in source["folded"]:
                words[w] = words.get(w, 0) + 1
            own = 0.0
            for word, times in sorted(words.items()):
                at = block.of(word)
                mine = forms.word_length_value(word, most) * times
                common[block.rows[at]] += np.minimum(q[at], mine)
                met[block.rows[at]] = True
                own += mine
            rows = np.flatnonzero(met)
            return rows, blocks.round6(2 * common[rows] / (total[rows] + own))

        return meet

    return _pairs(corpus, sources, ["folded"], "folded", kernel, "dice double")


def proximity(corpus: Corpus, sources: DataFrame) -> DataFrame:
    """PAIR rows with axes and proximity: how near every other verse is to each source, every pair of them.

    Labels go along, so that the pairs themselves are never shuffled.
    """
    second = Second.of(corpus)
    places = corpus.verses.select("id", "label", *REFERENCE, "chapter_ordinal").join(second.axes, "id")
    own = places.join(sources, F.col("id") == F.col("source_id")).select("source_id", F.struct(*places.columns).alias("source"))
    rows = places.crossJoin(own).where("id <> source_id")
    return second.proximity(rows, F.col("source")).select("source_id", "id", F.col("source.label").alias("source_label"), "label", "axes", "proximity")


class Ranking:
    """The first targets of sources, over one block of targets after the other.

    Overlap and rarity are summed for all; a target is aligned only if, with phrases as long as its word pairs
    allow, it could be among the first, and its phrases are chosen only if it still could.
    """

    def __init__(self, config: ScoringConfig, n: int, rare_threshold: int, keep: int, evidence: bool = True):
        self.config, self.n, self.rare_threshold, self.keep, self.evidence = config, n, rare_threshold, keep, evidence
        self.layer = LAYER[config.match_level]
        self.best: dict[int, list] = {}

    def block(self, batch: pa.RecordBatch) -> None:
        self.at = at = blocks.Block(batch, self.layer)
        self.sums, self.grams = Overlap(at, self.config, self.n, self.rare_threshold), blocks.Grams(at, 2)
        coded = {c: (at.codes, at.words) if c == self.layer else blocks.coded(batch.column(batch.schema.get_field_index(c))) for c in ("surface", "folded")}
        self.codes, self.words = {c: x for c, (x, _) in coded.items()}, {c: x for c, (_, x) in coded.items()}
        self.fields = {c: at.flat(c) for c in FIELDS}
        self.starts, self.rows = self.fields["starts"].astype(bool), {}

    def phrases(self, source: dict) -> np.ndarray:
        """A bound of each row's phrase component: what runs make of the source's word pairs that the row has."""
        squares, length, last = np.zeros(self.at.size), np.zeros(self.at.size, np.int64), np.full(self.at.size, -2)
        for i, gram in enumerate(self.grams.of(self.at.numbered(source[self.layer])).tolist()):
            if gram >= 0:
                rows = self.at.row[self.grams.places(gram)]
                now = np.where(last[rows] == i - 1, length[rows], 0) + 1
                squares[rows] += np.where(now == 1, 4, 2 * now + 1)  # once for a row, however often it has the pair
                length[rows], last[rows] = now, i
        return np.clip(squares * max(self.config.phrase_multipliers.values()) / self.config.phrase_cap, 0, 1)

    def order_and_case(self, source: dict, rows: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms, df = source["normalized"], source["df"]
        weights = np.array([float(blocks.idf(d, self.n)) * self.config.token_multipliers.get(w, 1) for w, d in zip(norms, df)])
        mine = {c: [names.get(w, -1) for w in source[c]] for c, names in self.words.items()}

        def multiplier(i: int, places: np.ndarray) -> np.ndarray:
            there, begins = self.starts[places], source["starts"][i]
            one, form = (self.codes[c][places] == mine[c][i] for c in ("surface", "folded"))
            return np.where(one, np.where(there | begins, 0.5, 1.0), np.where(form & (there != begins), 0.25, 0.0))

        n, apart, weight, case = self.at.walk(rows, self.at.numbered(source[self.layer]), weights, multiplier)
        if self.config.token_multipliers:
            light = {w for w, x in zip(source[self.layer], weights) if x <= 0}
            shared = shared.copy()
            for word in light:
                shared -= np.isin(rows, self.at.rows[self.at.of(word)])
        mean = np.divide(apart, n - 1, out=np.zeros(len(rows)), where=n > 1)
        order = np.where(n > 0, n / np.maximum(1, shared) * (1 / (1 + mean)), 0)
        return np.clip(order, 0, 1), np.divide(case, weight, out=np.zeros(len(rows)), where=weight != 0)

    def meet(self, source: dict) -> None:
        w, best = self.config.weights, self.best.setdefault(source["id"], [])
        rows, shared, jaccard, rare = self.sums.of(_words(source, self.layer, self.config, self.n))
        bound = w["jaccard"] * jaccard + w["phrase"] * self.phrases(source)[rows] + w["rare"] * rare
        open_ = self.at.ids[rows] != source["id"]
        while open_.any():  # the first ones set what the others must reach
            if len(best) == self.keep:
                part = np.flatnonzero(open_ & (bound >= best[0][0][0] - w["order"] - w["capitalization"] - MARGIN))
                open_[:] = False
            else:
                part = np.flatnonzero(open_)
                part = part[np.argsort(-bound[part], kind="stable")[: 4 * self.keep]]
                open_[part] = False
            self._score(source, *(x[part] for x in (rows, shared, jaccard, rare, bound)), best)

    def _score(self, source: dict, rows: np.ndarray, shared: np.ndarray, jaccard: np.ndarray, rare: np.ndarray, bound: np.ndarray, best: list) -> None:
        w = self.config.weights
        order, case = self.order_and_case(source, rows, shared)
        bound = bound + w["order"] * order + w["capitalization"] * case
        for k in np.argsort(-bound, kind="stable").tolist():
            if len(best) == self.keep and bound[k] < best[0][0][0] - MARGIN:
                break
            target = self.target(int(rows[k]))
            _, phrase = pairs.common_phrases(source, target, self.config)
            score = 0.0
            for name, x in (("jaccard", jaccard[k]), ("phrase", phrase), ("rare", rare[k]), ("order", order[k]), ("capitalization", case[k])):
                score += w[name] * float(x)
            key = (*(pairs.round6(float(x)) for x in (score, phrase, rare[k], jaccard[k])), 0.0, -target["id"])  # as rank_key
            if len(best) < self.keep:
                heappush(best, (key, target["id"], target if self.evidence else None))
            elif key > best[0][0]:
                heappushpop(best, (key, target["id"], target if self.evidence else None))

    def found(self, source: dict) -> list[tuple[int, dict]]:
        """The first targets' ids in ranking order, with their evidence, or else their score."""
        if not self.evidence:
            return [(id_, {"score": key[0]}) for key, id_, _ in sorted(self.best.pop(source["id"], []), reverse=True)]
        rows = [(id_, pairs.score_pair(source, target, self.config, self.n, self.rare_threshold)) for _, id_, target in self.best.pop(source["id"], [])]
        return sorted(rows, key=lambda r: rank_key(r[1], r[0]), reverse=True)

    def target(self, row: int) -> dict:
        """A target's feature row."""
        if row not in self.rows:
            a = self.at.first[row]
            self.rows[row] = {"id": int(self.at.ids[row]), **{c: x[a : a + self.at.lengths[row]].tolist() for c, x in self.fields.items()}}
        return self.rows[row]


def related(corpus: Corpus, sources: DataFrame, limit: int = 50, config: ScoringConfig | None = None, evidence: bool = True) -> DataFrame:
    """The first `limit` verses related to each source: EXPLANATION rows with rank from 1, labels and places.

    Without evidence only the score of a pair comes with them, and none is made.

    A task reads the staged targets in blocks for its sources, so that it knows what a target must reach
    to be among the first of a source; nothing but the sources is shuffled.
    """
    config = config or ScoringConfig()
    n, rare_threshold = corpus.size_and_threshold
    place = ["label", "book", *REFERENCE]
    features = corpus.features if corpus.is_written else staged(corpus.features)
    files = features.inputFiles()
    kind = f"{EXPLANATION if evidence else 'source_id bigint, id bigint, score double'}, rank int, source_label string, source_book_order int, label string, book string, book_order int, chapter int, verse int"
    schema = to_arrow_schema(corpus.spark.createDataFrame([], kind).schema)
    columns = ["id", *place, *FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in chain.from_iterable((batch.slice(k, BLOCK) for k in range(0, len(batch), BLOCK)) for batch in batches):
            ranking, searched = Ranking(config, n, rare_threshold, limit, evidence), own.to_pylist()
            places: dict[int, dict] = {}
            for batch in _read(files, TARGETS, columns):
                ranking.block(batch)
                for source in searched:
                    ranking.meet(source)
                first = {id_ for best in ranking.best.values() for _, id_, _ in best}
                places = {k: v for k, v in places.items() if k in first}
                here = [k for k, id_ in enumerate(ranking.at.ids.tolist()) if id_ in first]
                places |= {x["id"]: x for x in batch.select(["id", *place]).take(pa.array(here, pa.int64())).to_pylist()}
            out = []
            for source in searched:
                also = {"source_id": source["id"], "source_label": source["label"], "source_book_order": source["book_order"]}
                for rank, (id_, found) in enumerate(ranking.found(source), 1):
                    out.append(found | places[id_] | also | {"rank": rank})
                while len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out[:ROWS], schema)
                    out = out[ROWS:]
            yield pa.RecordBatch.from_pylist(out, schema)

    wanted = features.join(sources, F.col("id") == F.col("source_id")).select(*columns)
    return wanted.repartition(3 * corpus.spark.sparkContext.defaultParallelism).mapInArrow(run, kind)


def candidate_mates(corpus: Corpus, sources: DataFrame, limit: int = 20) -> DataFrame:
    return related(corpus, sources, limit).withColumn("evidence_types", evidence_types())


def lexical_witnesses(corpus: Corpus, sources: DataFrame, count: int = 3, candidate_limit: int = 100) -> DataFrame:
    """The best verse of each other book for each source, the first `count` in ranking order."""
    rows = related(corpus, sources, candidate_limit, evidence=False).where("book_order <> source_book_order")
    best = rows.withColumn("first", F.row_number().over(Window.partitionBy("source_id", "book_order").orderBy("rank"))).where("first = 1")
    of_source = Window.partitionBy("source_id")
    chosen = best.withColumn("witness", F.row_number().over(of_source.orderBy("rank"))).where(F.col("witness") <= count)
    return chosen.withColumn("complete", F.count(F.lit(1)).over(of_source) == count)
