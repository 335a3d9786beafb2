"""Gene-set enrichment of per-compound gene lists.

The sparse (compound x gene) @ (gene x term) product runs in tiles: a block of
compounds, dealt out by hash, gets the terms of the genes that it holds, each
gene once, so the shuffle is at most the number of matches; a block with very
many of them is cut by the terms, so a gene that stands in every list is shared
by many tiles instead of being one join key.  A tile counts its overlaps with
numpy and, for the p-values, sends the largest per (compound, term size) only.  p-values are exact hypergeometric tails; because the tail for
fixed (K, n) falls as k grows, only the largest overlap per (compound, term
size) can give the compound's minimum, and the tails of all k are suffix sums
over one pmf table per distinct (K, n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import hypergeom_pmf
from ..session import by_shuffle, drop_tables, in_round, materialize, materialize_rounds, rounds_of
from .ranks import prefix_agg


def load_gene_sets(lines: DataFrame, library_col: str = "library", priority_col: str = "priority") -> DataFrame:
    """S4 from GMT text: ``lines(library, priority, value)`` where value is
    ``term<TAB>description<TAB>gene...``; lines with < 3 fields are dropped,
    empty genes dropped, and an equal term name in a later (higher priority)
    library replaces the earlier one."""
    parts = F.split(F.col("value"), "\t")
    rows = (lines.select(library_col, priority_col, parts.alias("p"))
            .filter(F.size("p") >= 3)
            .select(library_col, priority_col, F.col("p")[0].alias("term"),
                    F.explode(F.slice("p", 3, F.size("p"))).alias("gene"))
            .filter(F.col("gene") != ""))
    return resolve_library_overrides(rows, library_col, priority_col)


def resolve_library_overrides(gs: DataFrame, library_col: str = "library", priority_col: str = "priority") -> DataFrame:
    """Keep, for each term name, only the rows of its highest-priority library."""
    best = gs.groupBy("term").agg(F.max(priority_col).alias(priority_col))
    return gs.join(by_shuffle(best), ["term", priority_col]).select(library_col, "term", "gene").distinct()


def gene_universe(gs: DataFrame) -> DataFrame:
    return gs.select("gene").distinct()


def term_sizes(gs: DataFrame, min_size: int = 10, max_size: int = 500) -> DataFrame:
    """``(term, n_genes)`` for terms with min..max distinct genes."""
    return (gs.select("term", "gene").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_genes"))
            .filter((F.col("n_genes") >= min_size) & (F.col("n_genes") <= max_size)))


BLOCK_GENES, TERM_GENES = 1 << 18, 1 << 23    # list entries of a tile: of its compounds, of its terms
PAIRS = 1 << 22                               # matches that a tile counts at a time
ROUND_GENES, ROUNDS = 1 << 21, 8              # list entries that a round of tiles has at least, rounds at most
NAME_GROUPS, MIN_PARTS = 64, 16


def _overlaps(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Compounds and term codes with their counts of common genes, in order and
    a part at a time; a compound with more matches than a part is added up."""
    row = pc.index_in(left["gene"], value_set=right["gene"].combine_chunks()).fill_null(-1).to_numpy()
    told = left["compound"].combine_chunks().dictionary_encode(null_encoding="encode")
    c, compounds = told.indices.to_numpy(zero_copy_only=False), told.dictionary
    order = np.argsort(c, kind="stable")
    order = order[row[order] >= 0]
    c, row = c[order].astype(np.int64), row[order]
    codes = right["codes"].combine_chunks()
    flat, size = codes.flatten().to_numpy(), codes.value_lengths().to_numpy().astype(np.int64)
    begin, n = (np.cumsum(size) - size)[row], size[row]
    base = int(flat.max(initial=0)) + 1
    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    upto = np.cumsum(n)
    at = 0
    while at < len(c):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        some = slice(at, to)
        within = np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        key, k = np.unique(np.repeat(c[some] * base, n[some]) + flat[np.repeat(begin[some], n[some]) + within],
                           return_counts=True)
        if len(keys):
            key, place = np.unique(np.concatenate([keys, key]), return_inverse=True)
            k = np.bincount(place, weights=np.concatenate([counts, k])).astype(np.int64)
        done = len(key) if to == len(c) else int(np.searchsorted(key, c[to] * base))
        if done:
            yield compounds.take(pa.array(key[:done] // base)), key[:done] % base, k[:done]
        keys, counts = key[done:], k[done:]
        at = to


def _tiles(query_genes: DataFrame, tg: DataFrame, fn, schema: str, block_genes: int,
           term_genes: int | None = None, each=None, rounds: int | None = None) -> DataFrame:
    """``fn`` of every tile of ``(gene, compound)`` and ``(gene, codes)``, from
    ``(compound, gene)`` and ``(rgene, code)``; rows may repeat in the latter.

    A block of compounds gets the terms of its own genes only, each gene once.
    Where these are more than ``term_genes`` entries, the block is cut into as
    many tiles by the code of the term, a power of two.

    ``each`` is what a caller makes of the tiles' rows, compound by compound.
    With it, the blocks take turns: a round's tiles are run, reduced and
    written, and its shuffle is gone before the next round's is made."""
    n_c = F.greatest(F.lit(1), F.ceil(query_genes.agg(F.count("*")).scalar() / F.lit(block_genes))).cast("int")
    left = query_genes.select(F.pmod(F.xxhash64("compound"), n_c).cast("int").alias("cb"), "gene", "compound")
    spark, turns = query_genes.sparkSession, rounds_of(query_genes.count()) if each else 1
    # written on their own, some genes at a time: their shuffles are gone before the blocks' are made
    lists = materialize_rounds(spark, lambda i: tg.where(in_round("rgene", i, turns)).groupBy("rgene").agg(
        F.array_sort(F.collect_set("code")).alias("codes")), turns, "term-lists")

    def asked_terms(i: int) -> DataFrame:
        mine = left.where(in_round("gene", i, turns)).groupBy("gene").agg(F.collect_set("cb").alias("blocks"))
        told = by_shuffle(lists.where(in_round("rgene", i, turns)))
        return mine.join(told, F.col("gene").eqNullSafe(F.col("rgene"))).select("gene", "blocks", "codes")

    listed = materialize_rounds(spark, asked_terms, turns, "asked-terms")
    if each:
        drop_tables(lists)
    asked = listed
    asked = asked.select(F.explode("blocks").alias("cb"), "gene", "codes")
    cut = F.ceil(F.log2(F.greatest(F.lit(1.0), F.sum(F.size("codes")) / F.lit(term_genes or block_genes))))
    cuts = materialize(asked.groupBy("cb").agg(F.pow(F.lit(2), cut).cast("int").alias("n_t")), "term-cuts")
    mine = F.filter("codes", lambda x: F.pmod(x, F.col("n_t")) == F.col("tb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = fn(a, b)
        return out if isinstance(out, pa.Table) else pa.Table.from_pandas(out, preserve_index=False)

    def tiled(some: DataFrame) -> DataFrame:
        spread = lambda df: (df.join(F.broadcast(some), "cb")
                             .withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1))))
        a = spread(left).select("cb", "tb", "gene", "compound")
        b = spread(asked).withColumn("codes", F.when(F.col("n_t") == 1, F.col("codes")).otherwise(mine))
        b = b.where(F.size("codes") > 0).select("cb", "tb", "gene", "codes")
        return a.groupBy("cb", "tb").cogroup(b.groupBy("cb", "tb")).applyInArrow(run, schema)

    if each is None:
        return tiled(cuts)
    if rounds is None:
        rounds = min(ROUNDS, max(1, query_genes.count() // ROUND_GENES))
    out = materialize_rounds(spark, lambda i: each(tiled(cuts.where(F.pmod("cb", F.lit(rounds)) == i))), rounds, "tiles")
    drop_tables(listed, cuts)
    return out


def _numbered_terms(gs: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """``(term, n_genes, code)``: terms numbered by size, so a code tells its size."""
    turns = rounds_of(gs.count())
    terms = materialize_rounds(
        gs.sparkSession, lambda i: term_sizes(gs.where(in_round("term", i, turns)), min_size, max_size)
        .withColumn("part", F.pmod(F.xxhash64("term"), F.lit(NAME_GROUPS))), turns, "term-sizes")
    # one row a size and part of the names, however many terms there are
    before = Window.orderBy("n_genes", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = terms.groupBy("n_genes", "part").agg(F.count("*").alias("n"))
    first = first.select("n_genes", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("n_genes", "part").orderBy("term"))
    numbered = materialize(terms.withColumn("within", within).join(first, ["n_genes", "part"]).select(
        "term", "n_genes", (F.col("first") + F.col("within") - 1).cast("int").alias("code")), "numbered-terms")
    drop_tables(terms)
    return numbered


def _distinct_lists(query_genes: DataFrame) -> DataFrame:
    """``(compound, gene)``, each once, as a table."""
    turns = rounds_of(query_genes.count())
    pairs = query_genes.select("compound", "gene")
    return materialize_rounds(query_genes.sparkSession, lambda i: pairs.where(in_round("compound", i, turns)).distinct(),
                              turns, "query_genes")


def _sized_genes(gs: DataFrame, min_size: int, max_size: int, terms: DataFrame | None = None) -> DataFrame:
    """``(code, rgene)`` of the terms of allowed size, as often as ``gs`` has them."""
    terms = _numbered_terms(gs, min_size, max_size) if terms is None else terms
    return gs.select("term", F.col("gene").alias("rgene")).join(by_shuffle(terms), "term").select("code", "rgene")


def _size_of(terms: DataFrame):
    """A function from term codes to term sizes: codes rise with the size, so it
    holds the first code of each size."""
    rows = sorted((r["code"], r["n_genes"]) for r in
                  terms.groupBy("n_genes").agg(F.min("code").alias("code")).collect())
    first, sizes = np.array([x for x, _ in rows], dtype=np.int64), np.array([x for _, x in rows], dtype=np.int64)
    return lambda code: sizes[np.searchsorted(first, code, "right") - 1]


def _table(parts: list[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(parts, schema=schema)


def term_overlap(query_genes: DataFrame, gs: DataFrame, min_size: int = 10, max_size: int = 500,
                 block_genes: int = BLOCK_GENES, term_genes: int = TERM_GENES, each=None,
                 rounds: int | None = None) -> DataFrame:
    """``(compound, term, k, n_genes)`` for every non-zero overlap, or what
    ``each`` makes of a round's rows, which are all rows of its compounds."""
    terms = _numbered_terms(gs, min_size, max_size)
    size_of = _size_of(terms)
    schema = pa.schema([("compound", pa.string()), ("code", pa.int32()), ("k", pa.int32()), ("n_genes", pa.int32())])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        return _table([pa.record_batch([compound.cast(pa.string()), *(pa.array(x.astype(np.int32)) for x in (code, k, size_of(code)))],
                                       schema=schema) for compound, code, k in _overlaps(left, right)], schema)

    qg = _distinct_lists(query_genes)
    # unique by code: Spark leaves the join out where nobody reads the name
    names = terms.groupBy("code").agg(F.first("term").alias("term"))

    def named(found: DataFrame) -> DataFrame:
        rows = found.join(by_shuffle(names), "code", "left").select("compound", "term", F.col("k").cast("long").alias("k"),
                                                        F.col("n_genes").cast("long").alias("n_genes"))
        return each(rows) if each else rows

    tiles = _tiles(qg, _sized_genes(gs, min_size, max_size, terms), count,
                   "compound string, code int, k int, n_genes int", block_genes, term_genes,
                   named if each else None, rounds)
    if each:
        drop_tables(qg, terms)
    return tiles if each else named(tiles)


def largest_overlaps(qg: DataFrame, gs: DataFrame, min_size: int = 10, max_size: int = 500,
                     block_genes: int = BLOCK_GENES, term_genes: int = TERM_GENES, each=None,
                     rounds: int | None = None) -> DataFrame:
    """``(compound, n_genes, k)``: the largest overlap with a term of each size,
    or what ``each`` makes of a round's rows, which are all rows of its compounds."""
    terms = _numbered_terms(gs, min_size, max_size)
    size_of = _size_of(terms)
    schema = pa.schema([("compound", pa.string()), ("n_genes", pa.int32()), ("k", pa.int32())])

    def most(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for compound, code, k in _overlaps(left, right):
            size = size_of(code)
            # in the order of compounds and codes, equal sizes of a compound stand together
            told = compound.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (told[1:] != told[:-1]) | (size[1:] != size[:-1])]))
            parts.append(pa.record_batch([compound.take(pa.array(edge)).cast(pa.string()), pa.array(size[edge].astype(np.int32)),
                                          pa.array(np.maximum.reduceat(k, edge).astype(np.int32))], schema=schema))
        return _table(parts, schema)

    # dealt out by compound: the maxima and the join of the list sizes that follows read one
    # shuffle, in parts that stay as small on a larger input
    parts = max(MIN_PARTS, -(-qg.count() // block_genes))

    def largest(found: DataFrame) -> DataFrame:
        rows = found.repartition(parts, "compound").groupBy(
            "compound", F.col("n_genes").cast("long").alias("n_genes")).agg(F.max("k").cast("long").alias("k"))
        return each(rows) if each else rows

    tiles = _tiles(qg, _sized_genes(gs, min_size, max_size, terms), most, "compound string, n_genes int, k int",
                   block_genes, term_genes, largest if each else None, rounds)
    if each:
        drop_tables(terms)
    return tiles if each else largest(tiles)


def upper_tails(cand: DataFrame, big_n: Column) -> DataFrame:
    """``(n_genes, n, k, p)``: exact hypergeometric tails P(X >= k) for every
    distinct triple of ``cand``.

    One row a pair (n_genes, n) holds its overlaps k; the tails of all k are one
    running sum of the pmf, smallest terms first.  A pair's support has at most
    its term size, so no row grows with the data."""
    pairs = (cand.select("n_genes", "n", "k").distinct().groupBy("n_genes", "n")
             .agg(F.collect_list("k").alias("ks")).withColumn("big_n", big_n))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for size, n, ks, total in frame[["n_genes", "n", "ks", "big_n"]].itertuples(index=False):
                pmf, low = hypergeom_pmf(int(total), int(size), int(n))
                tail = np.append(np.cumsum(pmf[::-1])[::-1], 0.0)
                ks = np.asarray(ks, dtype=np.int64)
                p = np.minimum(tail[np.clip(ks - low, 0, len(pmf))], 1.0)
                out.append((np.full(len(ks), size), np.full(len(ks), n), ks, p))
            if out:
                yield pd.DataFrame(dict(zip(("n_genes", "n", "k", "p"), (np.concatenate(x) for x in zip(*out)))))

    return pairs.mapInPandas(run, "n_genes long, n long, k long, p double")


def compound_best_p(query_genes: DataFrame, gs: DataFrame, min_size: int = 10, max_size: int = 500,
                    rounds: int | None = None) -> DataFrame:
    """Per compound, ``n`` (genes inside the universe), ``best_p`` (minimum
    upper-tail p over terms with overlap, 1 if none) and ``has_result`` (n > 0)."""
    universe = materialize(gene_universe(gs), "gene-universe")
    big_n = universe.agg(F.count(F.lit(1))).scalar()
    # the per-compound gene lists feed three branches: write them once
    qg = _distinct_lists(query_genes)
    turns = rounds_of(qg.count())
    n_in = materialize_rounds(
        qg.sparkSession, lambda i: qg.where(in_round("compound", i, turns)).join(by_shuffle(universe), "gene", "left_semi")
        .groupBy("compound").agg(F.count(F.lit(1)).alias("n")), turns, "enrichment_list_sizes")
    spent = []

    def best_of(per_size: DataFrame) -> DataFrame:
        # the round before is written by now
        drop_tables(*spent)
        # one row per (compound, term size), read by the triple extraction and the
        # join back: written once so the overlap tiles run once
        cand = materialize(per_size.join(by_shuffle(n_in), "compound"), "enrichment_candidates")
        spent[:] = [cand]
        pv = upper_tails(cand, big_n)
        return cand.join(by_shuffle(pv), ["k", "n_genes", "n"]).groupBy("compound").agg(F.min("p").alias("best_p"))

    best = largest_overlaps(qg, gs, min_size, max_size, each=best_of, rounds=rounds)
    compounds = qg.select("compound").distinct()
    out = (compounds.join(by_shuffle(n_in), "compound", "left").join(by_shuffle(best), "compound", "left")
           .select("compound", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                   F.when(F.col("n") > 0, F.coalesce("best_p", F.lit(1.0))).otherwise(F.lit(1.0)).alias("best_p"),
                   (F.coalesce("n", F.lit(0)) > 0).alias("has_result")))
    # one row per compound: written once, so the global BH ranking that follows
    # reads a small table instead of re-running the overlap tiles
    out = materialize(out, "enrichment_best_p")
    drop_tables(universe, qg, n_in, best, *spent)
    return out


def bh_adjust(df: DataFrame, p_col: str = "p", out_col: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg step-up adjustment, capped at 1.

    For a distinct p-value v with c(v) values <= v among m: q(v) = v*m/c(v) and
    adj(v) = min over v' >= v of q(v').  Both orderings run through the
    bucketed prefix helper, never a single-partition window.
    """
    d = df.filter(F.col(p_col).isNotNull())
    m = d.agg(F.count(F.lit(1))).scalar()
    vc = d.groupBy(p_col).agg(F.count(F.lit(1)).alias("n"))
    cum = prefix_agg(vc, p_col, ["n"], inclusive=True, suffix="_cum")
    q = cum.withColumn("q", F.col(p_col) * m / F.col("n_cum"))
    adj = prefix_agg(q, p_col, ["q"], agg="min", descending=True, inclusive=True, suffix="_min")
    adj = adj.select(p_col, F.least(F.col("q_min"), F.lit(1.0)).alias(out_col))
    return df.join(adj, p_col, "left")


def enrichment_scores(best: DataFrame) -> DataFrame:
    """E3 + E4: BH over compounds with genes, then ``-log10(max(adj, 1e-300))``;
    0 for compounds without genes."""
    adj = bh_adjust(best.filter(F.col("has_result")), "best_p", "p_adj").select("compound", "p_adj")
    j = best.join(by_shuffle(adj), "compound", "left")
    return j.select("compound", "n", "best_p",
                    F.when(F.col("has_result"), F.col("p_adj")).otherwise(F.lit(1.0)).alias("p_adj"),
                    F.when(F.col("has_result"), -F.log10(F.greatest(F.col("p_adj"), F.lit(1e-300))))
                    .otherwise(F.lit(0.0)).alias("enrich_score_raw"))


def coverage_report(scores: DataFrame) -> DataFrame:
    """Compounds with a non-zero enrichment score, and their share."""
    return scores.agg(F.count(F.lit(1)).alias("n_compounds"),
                      F.sum(F.when(F.col("enrich_score_raw") > 0, 1).otherwise(0)).alias("n_enriched")).select(
        F.col("n_enriched").cast("long").alias("n_enriched"), F.col("n_compounds").cast("long").alias("n_compounds"),
        (100.0 * F.col("n_enriched") / F.col("n_compounds")).alias("pct_enriched"))
