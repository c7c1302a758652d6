"""A dictionary: the string set, its canonical k-mer index and its super-k-mers, as lazy tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import BuildConfig
from strandloom.operators import buckets as B
from strandloom.operators import lookups, own, reports, scan, seeds, strings, windows
from strandloom.operators import sketch as sketches
from strandloom.sources.chunked import SIZE
from strandloom.staging import DROP_SHUFFLES, held_conf, staged

FORMAT, VERSION = "strandloom-dictionary", 2
#: Bases of strings whose k-mers are shuffled at once when an index is stored.
BASES_A_PASS = 1 << 27


class DictionaryFormatError(ValueError):
    """The folder holds no dictionary of a version that this code reads."""


@dataclass(frozen=True)
class KmerDictionary:
    """``strings`` and ``index`` (one row per canonical k-mer), with the parameters they were built by."""

    config: BuildConfig
    strings: DataFrame
    index: DataFrame
    #: Whether the index is still to be made of the strings' letters, so that scans may meet these at once.
    unmade: bool = False

    @cached_property
    def super_kmers(self) -> DataFrame:
        c = self.config
        return windows.super_kmers(self.strings, c.k, c.m, c.canonical, c.seed)

    @cached_property
    def buckets(self) -> DataFrame:
        return B.buckets(self.super_kmers)

    def query(self, kmers: DataFrame) -> DataFrame:
        return lookups.lookup(kmers, self.index, self.config.k, self.config.canonical)

    def contains(self, kmers: DataFrame, absent: bool = False) -> DataFrame:
        return lookups.members(kmers, self.index, self.config.k, absent)

    @cached_property
    def sketch(self) -> sketches.Sketch | None:
        """Which k-mers may be held, for many queries of which few are; None if it would be too large to send."""
        return sketches.sketch_keys(self.index, self.config.k)

    def contains_sketched(self, kmers: DataFrame, absent: bool = False) -> DataFrame:
        """As ``contains``; what the sketch rules out is not shuffled."""
        return sketches.members_sketched(kmers, self.index, self.config.k, self.sketch, absent)

    def windows_sketched(self, seqs: DataFrame, absent: bool = False) -> DataFrame:
        """The windows of sequences (their columns, ``pos, kmer``) that are held, or are not; runs that the sketch rules out are not shuffled."""
        return sketches.windows_sketched(seqs, self.known_runs, self.config.k, absent)

    @cached_property
    def known_runs(self) -> DataFrame:
        return lookups.known_runs(self.strings, self.config.k)

    def stream_query(self, reads: DataFrame) -> DataFrame:
        """The lookup of every window of ``reads``: in a stored index, or else in the strings' own runs of windows."""
        if self.unmade and not reads.isStreaming:
            return lookups.lookup_runs(reads, self.known_runs, self.config.k, self.config.canonical)
        return scan.scan_lookup(reads, self.index, self.config.k, self.config.canonical)

    @cached_property
    def is_unique(self) -> bool:
        """Whether every k-mer has one place on either strand: as many places are stored as there are k-mers."""
        places = self.strings.agg(F.coalesce(F.sum(F.col("string_end") - F.col("string_begin") - self.config.k + 1), F.lit(0))).first()[0]
        return self.index.count() == places

    def runs(self, reads: DataFrame) -> DataFrame:
        """Every search of a scan of ``reads`` (``query_id, seq``) and how far its string is followed, whether or not k-mers repeat."""
        return self._followed(reads)[1]

    def _followed(self, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The lookup of every window and the searches; reads are written first, since both read them and ids may be made on the fly."""
        reads = staged(reads.select("query_id", "seq"), "reads")
        found = staged(self.stream_query(reads), "scan")
        return found, seeds.seeded_runs(found, reads, self.strings, self.config.k)

    def stats(self, reads: DataFrame, unique: bool | None = None) -> DataFrame:
        """The counters of a scan of ``reads``.  ``unique`` tells whether every k-mer has one place; by default that is found out.

        With one place each, a window's neighbours tell whether it is an extension; else the scan is followed.
        """
        if self.is_unique if unique is None else unique:
            return scan.scan_stats(self.stream_query(reads))
        return seeds.seeded_stats(*self._followed(reads))

    @cached_property
    def own_strings(self) -> DataFrame:
        return staged(self.strings, "own-strings")

    def query_own(self) -> DataFrame:
        """``stream_query`` of the dictionary's own strings, by their further columns: they are shuffled once, as known and asked at once."""
        return own.lookup_own(self.strings, self.config.k, self.config.canonical)

    def query_own_turned(self) -> DataFrame:
        """``turned, pos, kmer_offset, orientation`` of every window of the own strings and (``turned``) of their reverse complements."""
        return own.lookup_both_strands(self.strings, self.config.k, self.config.canonical)

    def runs_own(self) -> DataFrame:
        """``runs`` of the own strings and their reverse complements: ``query_id`` is the string's id, or -1 less it."""
        if self.config.canonical:  # a first place may be on either strand, so the scan is followed as any other
            return self.runs(own.both_strands(self.own_strings))
        return own.own_searches(self.own_strings, self.config.k)

    def stats_own(self) -> DataFrame:
        """``stats`` of the own strings and their reverse complements."""
        return own.own_stats(self.own_strings, self.runs_own(), self.config.k)

    def locate(self, positions: DataFrame, position: str = "pos") -> DataFrame:
        return strings.locate(positions, self.strings, position)

    def kmer_at(self, positions: DataFrame, position: str = "pos") -> DataFrame:
        return strings.kmer_at(positions, self.strings, self.config.k, position)

    def access(self, wanted: DataFrame) -> DataFrame:
        return strings.kmer_in_string(wanted, self.strings, self.config.k)

    def access_ranges(self, ranges: DataFrame) -> DataFrame:
        """As ``access`` for every place of ranges (``string_id, first, last``) of strings."""
        return strings.kmers_in_ranges(ranges, self.strings, self.config.k)

    def totals(self) -> DataFrame:
        c = self.config
        return reports.dictionary_totals(self.strings, self.super_kmers, c.k, c.m, c.canonical)

    def check(self) -> DataFrame:
        """The first missing k-mers of its own strings, in order: none if all is well."""
        return reports.first_missing(lookups.missing_windows(self.strings, self.index, self.config.k))

    def check_totals(self) -> DataFrame:
        """``windows, missing``: one row; how many k-mers of its own strings were asked, and how many of them are not found."""
        return reports.check_totals(self.stream_query(self.strings.select("seq")))

    def save(self, path: str, partitions: int | None = None, most: int = BASES_A_PASS) -> None:
        """Two Parquet tables and a metadata file; an existing dictionary is never overwritten.

        The index is written in buckets of its key, sorted, so a loaded dictionary is never shuffled again: only the
        queries are, into its buckets.  ``partitions`` is their number, by default that of shuffle
        partitions; with fewer buckets than a session's shuffle partitions Spark would shuffle both sides.
        Of more than ``most`` bases the buckets are made some at a time, and what a pass shuffles goes when it is over: so only
        the index itself grows on disk.
        """
        spark = self.strings.sparkSession
        count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        meta = {"format": FORMAT, "version": VERSION, "buckets": count, **self.config.asdict()}
        name, keys = _table_name(), lookups.key_columns(self.config.k)
        with held_conf(spark, **DROP_SHUFFLES):
            self.strings.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/strings")
        held = spark.read.schema(self.strings.schema).parquet(f"{path}/strings")
        bases = held.agg(F.sum(F.col("string_end") - F.col("string_begin"))).first()[0] or 0
        index = lookups.index_kmers(held, self.config.k) if self.unmade else self.index
        passes = min(count, max(1, -(-bases // most)))
        # The minima leave keys dealt as the buckets are, if tasks are as many; keys of several limbs are dealt once more.
        with held_conf(spark, spark__sql__shuffle__partitions=str(count), spark__sql__adaptive__coalescePartitions__enabled="false", **DROP_SHUFFLES):
            for i in range(passes):
                part = index.filter(F.pmod(F.hash(*keys), F.lit(count)) % passes == i) if passes > 1 else index
                part = part if len(keys) == 1 else part.repartition(count, *keys)
                part.write.mode("append").format("parquet").option("compression", "zstd").bucketBy(count, *keys).sortBy(*keys).option("path", f"{path}/index").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta")


def _table_name() -> str:
    return f"strandloom_{uuid.uuid4().hex}"


def _stored_index(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """The index's files as a bucketed table of this session."""
    schema = spark.read.parquet(path).schema
    name, columns = _table_name(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def build_dictionary(seqs: DataFrame, config: BuildConfig | None = None, order: str = "id") -> KmerDictionary:
    """The dictionary of sequences (``seq`` and the integer order column); nothing runs until it is queried."""
    config = config or BuildConfig()
    held = strings.string_set(seqs, config.k, config.on_invalid, order)
    return KmerDictionary(config, held, lookups.index_kmers(held, config.k), unmade=True)


def build_from_chunks(chunks: DataFrame, config: BuildConfig | None = None, size: int = SIZE) -> KmerDictionary:
    """The dictionary of records in chunks (``sources.read_fasta_chunks`` with the same k and ``size``), of any length each.

    Its strings have names and no letters: lookups, scans of unique k-mers, membership and positions work; what
    reads stored letters (``access``, ``kmer_at``, ``super_kmers``, ``check``, ``runs``) does not.
    """
    config = config or BuildConfig()
    held = strings.chunked_set(chunks)
    return KmerDictionary(config, held, lookups.index_chunks(chunks, held, config.k, size))


def load_dictionary(spark: SparkSession, path: str) -> KmerDictionary:
    found = spark.read.text(f"{path}/meta", wholetext=True).head()
    try:
        meta = json.loads(found["value"]) if found else {}
    except ValueError as e:
        raise DictionaryFormatError(f"{path} has no readable metadata") from e
    if meta.pop("format", None) != FORMAT or meta.pop("version", None) != VERSION:
        raise DictionaryFormatError(f"{path} is not a dictionary of version {VERSION}")
    buckets, config = meta.pop("buckets"), BuildConfig(**meta)
    index = _stored_index(spark, f"{path}/index", lookups.key_columns(config.k), buckets)
    return KmerDictionary(config, spark.read.parquet(f"{path}/strings"), index)


def occurrences(dictionary: KmerDictionary) -> DataFrame:
    """``kmer, count`` of every stored k-mer."""
    own = windows.kmer_windows(dictionary.strings.select("seq"), dictionary.config.k, [])
    return own.groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))
