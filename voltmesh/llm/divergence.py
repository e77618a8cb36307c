"""How far the sources of a language differ in the terms they use, by DuckDB in shards (operator 12).

Tasks count the terms of their texts and add up before the shuffle. Counts are dealt to shards by a hash of lang and term, so a shard has
all counts of its terms; DuckDB sums them there and keeps the terms of enough documents. With the totals of all groups joined on, a second
SQL run in each shard gives partial sums for pairs of sources and the best terms of each group; Spark adds up and ranks.

A source that lacks a term still has a share of it, the same for all terms it lacks. So the sum over all kept terms of a pair is V times the
divergence of these floors, corrected for terms that the one or the other has (by a histogram of their counts), and again for terms that both have: the work of a
shard grows with the counts that occur, not with terms times sources times sources. All arithmetic is in integers.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, flat, slices, strings

#: Bytes of text that a task counts at a time, and rows of counts that it holds before it adds up or gives out.
SLICE, ROWS = 2 << 20, 1 << 20
#: What DuckDB may use in a shard before it writes to the task's own temporary folder.
MEMORY = "400MB"

# A term is a run of A-Z, a-z and everything from U+0080; only A-Z are lower-cased.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SHARE = 1_000_000_000


def _terms(body: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie behind each other, and the row of each."""
    keep = _TERM[body]
    before = np.concatenate([[False], keep[:-1]]) if len(keep) else keep
    before[at[:-1][at[:-1] < len(body)]] = False
    begin = np.flatnonzero(keep & ~before)
    place = np.concatenate([[0], np.cumsum(keep)])
    return strings(_LOWER[body[keep]], np.append(place[begin], place[-1])), np.searchsorted(at, begin, side="right") - 1


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch of texts; one text longer than SLICE is taken in parts."""
    body, at = flat(batch.column("text"))
    groups = pa.table({c: batch.column(c) for c in ("lang", "source")})
    if batch.num_rows == 1 and len(body) > SLICE:
        parts, start = [], 0
        while start < len(body):
            stop = start + SLICE
            while stop < len(body) and _TERM[body[stop]]:
                stop += 1
            found = _terms(body[start:stop], np.array([0, min(stop, len(body)) - start]))[0].value_counts()
            parts.append(pa.table({"term": found.field("values"), "n": found.field("counts")}))
            start = stop
        own = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
        once = pa.array(np.zeros(len(own), np.int64))
        return pa.table({"lang": groups["lang"].take(once), "source": groups["source"].take(once), "term": own["term"], "n": own["n_sum"], "docs": pa.array(np.ones(len(own), np.int64))})
    found, row = _terms(body, at)
    seen = found.dictionary_encode()
    codes = seen.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each, n = np.unique(row << 32 | codes, return_counts=True)  # a document's term
    named = pc.dictionary_encode(pc.binary_join_element_wise(*(groups[c].combine_chunks().cast(pa.string()) for c in groups.column_names), "\0"))
    named = named.combine_chunks() if isinstance(named, pa.ChunkedArray) else named
    group = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.unique(group, return_index=True)[1]  # a row that has the group's lang and source
    pair, back, docs = np.unique(group[each >> 32] << 32 | each & 0xFFFFFFFF, return_inverse=True, return_counts=True)
    sums = np.zeros(len(pair), np.int64)
    np.add.at(sums, back, n)
    of = pa.array(first[pair >> 32])
    return pa.table({"lang": groups["lang"].take(of), "source": groups["source"].take(of), "term": seen.dictionary.take(pa.array(pair & 0xFFFFFFFF)), "n": sums, "docs": docs.astype(np.int64)})


_COUNTS = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()), ("n", pa.int64()), ("docs", pa.int64())])


def _small(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Batches of ordinary strings."""
    plain = pa.schema([(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in table.schema])
    yield from table.cast(plain).to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums of the tasks, not added up yet. docs: lang, source and text without nulls."""

    def run(batches):
        held = _COUNTS.empty_table()
        for batch in slices(batches, "text", SLICE):
            held = pa.concat_tables([held, _counted(batch).cast(_COUNTS)])
            if len(held) > ROWS:
                held = held.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_COUNTS.names).cast(_COUNTS)
            if len(held) > ROWS // 2:
                yield from _small(held)
                held = _COUNTS.empty_table()
        if len(held):
            yield from _small(held.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_COUNTS.names))

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


class _Shard:
    """A DuckDB that works for one task, on one thread and in bounded memory."""

    def __enter__(self):
        self.folder = tempfile.mkdtemp(prefix="shard-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder})
        self.con.execute("set preserve_insertion_order = false")
        return self

    def __exit__(self, *_):
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)

    def add(self, table: str, batch: pa.RecordBatch) -> None:
        self.con.register("batch", pa.Table.from_batches([batch]))
        made = self.con.execute("select count(*) from duckdb_tables() where table_name = ?", [table]).fetchone()[0]
        self.con.execute(f"insert into {table} select * from batch" if made else f"create table {table} as select * from batch")
        self.con.unregister("batch")

    def rows(self, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in self.con.sql(sql).to_arrow_reader(1 << 16):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, first) of the terms in at least ``min_docs`` documents of their lang; ``first`` is 1 in one row of each term and 0 in the others."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int32())])
    summed = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from counts group by all"

    def run(batches):
        with _Shard() as shard:
            held = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                shard.add("counts", batch)
                held += batch.num_rows
                if held > 4 * ROWS:
                    shard.con.execute(f"create table summed as {summed}; drop table counts; alter table summed rename to counts")
                    held = shard.con.execute("select count(*) from counts").fetchone()[0] // 2
            if held:
                sql = f"""with c as ({summed}), many as (select lang, term, min(source) as least from c group by all having sum(docs) >= {min_docs})
                    select lang, source, term, n, (source = least)::int as first from c join many using (lang, term)"""
                yield from shard.rows(sql, schema)

    return counts.repartition("lang", "term").mapInArrow(run, "lang string, source string, term string, n long, first int")


# Shares p of present terms, their floors p0, and the divergence f of two shares; tot and terms are a group's N and its lang's V.
_F = "((({0}) - ({1})) * (({0}) - ({1})) // (({0}) + ({1})))"
_PARTS = f"""
create table s as select *, (1 + {_SHARE}::hugeint * (n + 2) // (tot + 2 * terms))::bigint as p, (1 + {_SHARE}::hugeint * 2 // (tot + 2 * terms))::bigint as p0 from kept;
create table parts as
 select 'both' as kind, a.lang as lang, a.source as source, b.source as item, 0::bigint as n,
  sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.p0")} - {_F.format("a.p0", "b.p")} + {_F.format("a.p0", "b.p0")})::bigint as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
 union all select 'counts', lang, source, '', n, count(*)::bigint from s group by all
 union all select 'term', lang, source, term, 0::bigint, value from (
  select *, row_number() over (partition by lang, source order by value desc, term) as rank from (
   select lang, source, term, {_F.format("p", "q")} as value from (
    select *, (1 + {_SHARE}::hugeint * (sum(n) over (partition by lang, term) + 2) // (lang_tot + 2 * terms))::bigint as q from s) where p > q)) where rank <= {{top}};
"""


def shard_parts(kept: DataFrame, top: int) -> DataFrame:
    """(kind, lang, source, item, n, value): from each shard the sums over terms that both sources of a pair have, how many terms of a source have n
    occurrences, and the ``top`` terms of each group. kept: lang, source, term, n, tot, lang_tot, terms."""
    schema = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.int64())])

    def run(batches):
        with _Shard() as shard:
            held = 0
            for batch in batches:
                if batch.num_rows:
                    shard.add("kept", batch)
                    held += batch.num_rows
            if held:
                shard.con.execute(_PARTS.format(top=top))
                yield from shard.rows("select * from parts", schema)

    return kept.repartition("lang", "term").mapInArrow(run, "kind string, lang string, source string, item string, n long, value long")


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (N + 2 V)), beyond 64 bits on the way."""
    return F.lit(1) + F.call_function("div", F.lit(_SHARE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * terms).cast("decimal(20,0)"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) that occurs: in part ``pair`` all other sources of the lang with the divergence
    summed over all kept terms, in part ``term`` the ``top`` kept terms that the source has more often than its lang.

    Null langs, sources and texts count as ''. A lang without kept terms has pairs of value 0 and no terms; a lang of one source has no pairs; repeated
    rows count each time; ties go by the item's UTF-8 bytes; very long texts are counted in parts; an empty table gives an empty one; other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    docs = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = scratch.save(kept_terms(term_counts(docs), min_docs), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("tot"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_tot"), F.sum("first").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["tot", "lang_tot", "terms"])
    groups = scratch.save(groups, "groups")
    parts = scratch.save(shard_parts(kept.drop("first").join(groups, ["lang", "source"]), top), "parts")
    scratch.drop(kept)

    # no broadcast is asked for: Spark knows the size of the table of groups and sends it round only if it is small
    one = groups.where("terms > 0").withColumn("p0", _share(F.lit(0), F.col("tot"), F.col("terms")))
    other = one.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    counts = parts.where("kind = 'counts'").groupBy("lang", "source", "n").agg(F.sum("value").alias("times"))
    each = counts.join(one, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("tot"), F.col("terms"))).select("lang", "source", "p", "p0", "times")
    alone = each.join(other, "lang").where("source <> item")
    gain = F.col("times") * (_divergence(F.col("p"), F.col("q0")) - _divergence(F.col("p0"), F.col("q0")))
    added = [alone.select("lang", "source", "item", gain.alias("value")), alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), gain.alias("value"))]
    both = parts.where("kind = 'both'")
    added += [both.select("lang", "source", "item", "value"), both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")]
    floor = one.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("terms") * _divergence(F.col("p0"), F.col("q0"))).alias("value"))
    none = groups.where("terms = 0").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = floor.union(none)
    for x in added:
        pairs = pairs.union(x)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = pairs.withColumn("part", F.lit("pair")).unionByName(parts.where("kind = 'term'").select("lang", "source", "item", "value", F.lit("term").alias("part")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
