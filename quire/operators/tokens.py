"""Prompt wraps, token sequences and packing (PRJ4-PRJ8, TOK1-TOK7, WIN9, FLT1, FLT7).

The model tokenizer itself is not part of this library.  The default
splitter is a regular expression (words, single symbols, and the literal
special tokens); ``encode`` maps tokens to ids with a vocabulary table built
by ``build_vocab``.  A user tokenizer plugs in through ``map_tokenizer``
(``mapInPandas``, Arrow batches).

Encoding joins each chunk's distinct tokens to the vocabulary, not their
occurrences, and looks ids up by position inside the row (``chunks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Coded, code_tokens, encode_coded
from .ordering import DEFAULT_WIDTH, bucket_offsets, prefix_bits, with_global_index

# Special tokens and their ids, the splitter, the prompt format.
SPECIALS = ("<unk>", "<s>", "</s>")
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
EOS = "</s>"
IGNORE_ID = -100
TOKEN_RE = "</s>|<s>|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_ \\t\\n\\r\\f\\x0B]"
PROMPT_HEAD = "Write a response that appropriately completes the Input.\n\nInput:\n"
PROMPT_MID = "\n\nResponse:\n"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ---------------------------------------------------------------- wraps (PRJ4-PRJ8)

def ensure_suffix(col, suffix: str = EOS) -> Column:
    """PRJ6: append ``suffix`` only when absent."""
    c = _c(col)
    return F.when(c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def wrap_train(input_col, target_col, eos: str = EOS) -> Column:
    """PRJ4: training text = prompt + response + EOS (appended unconditionally)."""
    return F.concat(F.lit(PROMPT_HEAD), _c(input_col), F.lit(PROMPT_MID), _c(target_col), F.lit(eos))


def wrap_prompt(input_col) -> Column:
    """PRJ5: inference prompt, no response."""
    return F.concat(F.lit(PROMPT_HEAD), _c(input_col), F.lit(PROMPT_MID))


def preference_texts(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen",
                     rejected: str = "rejected", eos: str = EOS) -> DataFrame:
    """PRJ7: prompt + chosen + EOS and prompt + rejected + EOS."""
    return (df.withColumn("text_pos", F.concat(_c(prompt), _c(chosen), F.lit(eos)))
            .withColumn("text_neg", F.concat(_c(prompt), _c(rejected), F.lit(eos))))


def shape_columns(df: DataFrame, kind: str) -> DataFrame:
    """PRJ8: per dataset kind: rename/drop/add columns.  Unknown kinds pass through."""
    if kind == "preference":
        return df.withColumnRenamed("prompt", "input").withColumn("output", ensure_suffix("chosen"))
    if kind == "qa":
        return df.drop("SOURCE", "METADATA")
    if kind == "instruction":
        return (df.withColumn("output", ensure_suffix("target"))
                .withColumn("TEXT", wrap_train("input", "target")))
    return df


def shape_preference(df: DataFrame, kind: str) -> DataFrame:
    """PRJ8, preference path: only known kinds are accepted."""
    if kind == "preference":
        return preference_texts(df)
    if kind == "qa":
        return df.drop("SOURCE", "METADATA")
    raise NotImplementedError(f"unsupported dataset kind {kind!r}")


# ---------------------------------------------------------------- vocabulary and encoding (TOK1)

def tokenize(col) -> Column:
    """Default splitter: special tokens, runs of letters/digits/underscore, single other symbols."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_RE), 0)


def build_vocab(df: DataFrame, col: str, size: int | None = None) -> DataFrame:
    """TOK1: specials, then all tokens (or the ``size`` most frequent), by count desc, token asc.  Counting is a partial
    aggregate (map-side combine)."""
    counts = df.select(F.explode(tokenize(col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    return vocab_of_counts(counts, size)


def vocab_of_counts(counts: DataFrame, size: int | None = None) -> DataFrame:
    """TOK1 from (token, count).

    Ids come from ``with_global_index`` over buckets of the count and the token's first bytes (seven for counts below
    128, where very many tokens share a count, else three), so no task numbers the whole vocabulary.
    """
    counts = counts.filter(~F.col("token").isin(*SPECIALS)).withColumn("_rare", -F.col("count"))
    rare = (F.col("_rare") + 127) * F.lit(1 << 56) + prefix_bits("token", 7)
    often = F.col("_rare") * F.lit(1 << 24) + prefix_bits("token", 3)
    bucket = F.when(F.col("count") < 128, rare).otherwise(often)
    ranked = with_global_index(counts, ["_rare", "token"], "_id", bucket=bucket, levels=3)
    if size is not None:
        ranked = ranked.filter(F.col("_id") < size)
    specials = counts.sparkSession.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)],
                                                   "token string, id int, count long")
    return specials.unionByName(ranked.select("token", (F.col("_id") + len(SPECIALS)).cast("int").alias("id"),
                                              F.col("count").cast("long")))


def code_texts(df: DataFrame, key: Sequence[str], texts: dict[str, str]) -> Coded:
    """TOK1, first half: the texts as codes of their chunks (written once, see ``chunks``)."""
    return code_tokens(df, key, texts, TOKEN_RE)


def encode_texts(coded: Coded, vocab: DataFrame, bos: Sequence[str] = ()) -> DataFrame:
    """TOK1, second half: ids of coded texts, with BOS before those named in ``bos``."""
    out = encode_coded(coded, vocab, UNK_ID)
    return out.withColumns({n: F.concat(F.array(F.lit(BOS_ID)), n) for n in bos}) if bos else out


def coded_sizes(coded: Coded, key: Sequence[str], text: str, bos: bool = False) -> DataFrame:
    """(key, _n): how many ids a coded text has, without encoding it."""
    return coded.rows.select(*key, (F.size(text) + int(bos)).alias("_n"))


def encode(df: DataFrame, key: Sequence[str], texts: dict[str, tuple[str, bool]], vocab: DataFrame) -> DataFrame:
    """TOK1: ids per text column.  ``texts`` maps output name -> (text column, add BOS).

    Returns ``key`` + one ``array<int>`` column per entry; unknown tokens map to <unk>, a null text has no tokens.
    """
    coded = code_texts(df, key, {n: c for n, (c, _) in texts.items()})
    return encode_texts(coded, vocab, [n for n, (_, bos) in texts.items() if bos])


#: Characters of all tokens (and eight more for each) of a vocabulary that ``row_encoder`` ships to every worker: as
#: arrays, about half a gigabyte.
ROW_VOCAB_CHARS = 256_000_000


def token_hashes():
    """64-bit hashes of an array of strings.  (A function made here goes to the workers as it is; they need no module.)"""

    def hashes(tokens: pa.Array, rows: int = 1 << 18) -> np.ndarray:
        parts = [tokens.slice(i, rows).to_numpy(zero_copy_only=False) for i in range(0, len(tokens), rows)]
        return np.concatenate([np.zeros(0, np.uint64), *[pd.util.hash_array(p, categorize=False) for p in parts]])

    return hashes


def token_arrays(tokens: pa.ChunkedArray, ids: pa.ChunkedArray, hashes: Callable) -> tuple:
    """A vocabulary as three arrays in the order of the tokens' hashes (some 28 bytes a token, where a dict of strings
    takes 200), and a dict of those tokens, if any, that share a hash."""
    tokens = tokens.cast(pa.large_string()).combine_chunks()
    h = hashes(tokens)
    order = np.argsort(h, kind="stable")
    h, tokens, ids = h[order], tokens.take(pa.array(order)), ids.to_numpy().astype(np.int32)[order]
    twice = np.flatnonzero(h[1:] == h[:-1])
    return h, tokens, ids, {tokens[i].as_py(): int(ids[i]) for i in np.union1d(twice, twice + 1).tolist()}


def token_finder(hashes: Callable) -> Callable[[tuple, list[str], int], dict[str, int]]:
    """The ids of distinct tokens by ``token_arrays``: each is found by its hash and compared with the token there."""

    def find_ids(arrays, asked, unknown):
        h, tokens, ids, shared = arrays
        if not asked or not len(h):
            return dict.fromkeys(asked, unknown)
        wanted = pa.array(asked, pa.large_string())
        at = np.minimum(np.searchsorted(h, hashes(wanted)), len(h) - 1)
        same = pc.equal(tokens.take(pa.array(at)), wanted).to_numpy(zero_copy_only=False)
        found = dict(zip(asked, np.where(same, ids[at], unknown).tolist()))
        return found | {t: shared[t] for t in found.keys() & shared.keys()}

    return find_ids


def row_encoder(vocab: DataFrame, max_chars: int = ROW_VOCAB_CHARS) -> Callable[[Column], Column]:
    """TOK1 as a map: a column function from text to ids that needs no regrouping, for streams in append mode.

    Every worker holds the vocabulary (``token_arrays``), so its size is checked first; a larger one is an error here and is
    encoded by chunks (``encode``, in ``foreachBatch`` for a stream).  A null text has no tokens.
    """
    size = vocab.agg(F.coalesce(F.sum(F.char_length("token") + 8), F.lit(0)).alias("n")).first()["n"]
    if size > max_chars:
        raise ValueError(f"a vocabulary of {size} characters is too large for a map ({max_chars})")
    spark = vocab.sparkSession
    table = vocab.select("token", "id").toArrow()
    hashes = token_hashes()
    arrays = spark.sparkContext.broadcast(token_arrays(table.column("token"), table.column("id"), hashes))
    find_ids = token_finder(hashes)

    @F.pandas_udf("array<int>")
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        find, known = regex.compile(TOKEN_RE).findall, arrays.value
        for texts in batches:
            found = [find(x) if x else [] for x in texts.tolist()]
            id_of = find_ids(known, list(set().union(*found)), UNK_ID)
            yield pd.Series([[id_of[t] for t in f] for f in found])

    return lookup


def map_tokenizer(df: DataFrame, col: str, fn: Callable, name: str = "input_ids",
                  keep: Sequence[str] = ()) -> DataFrame:
    """UDF1: a user tokenizer over Arrow batches (``mapInPandas``); ``fn(list[str]) -> list[list[int]]``."""
    keep = list(keep)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
                       + [f"{name} array<int>"])

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            out[name] = fn(pdf[col].tolist())
            yield out

    return df.select(*keep, col).mapInPandas(run, schema)


# ---------------------------------------------------------------- labels and masks (TOK2-TOK7)

def labels_all(ids) -> Column:
    """TOK2: labels are the ids."""
    return _c(ids)


def labels_response(prompt_ids, response_ids, max_len: int) -> tuple[Column, Column, Column]:
    """TOK3/TOK4: ids = prompt + response; labels ignore the prompt; all cut to ``max_len``."""
    p, r = _c(prompt_ids), _c(response_ids)
    ids = F.slice(F.concat(p, r), 1, max_len)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORE_ID), F.size(p)), r), 1, max_len)
    mask = F.slice(F.array_repeat(F.lit(1), F.size(p) + F.size(r)), 1, max_len)
    return ids, labels, mask


def attention_mask(ids) -> Column:
    """TOK4: ones, one per id."""
    return F.array_repeat(F.lit(1), F.size(_c(ids)))


def truncate_ids(ids, max_len: int) -> Column:
    """TOK6: keep the first ``max_len`` ids."""
    return F.slice(_c(ids), 1, max_len)


def filter_max_len(df: DataFrame, col: str, n: int) -> DataFrame:
    """FLT1 / UDF2: keep rows whose sequence has at most ``n`` ids."""
    return df.filter(F.size(col) <= n)


# ---------------------------------------------------------------- packing (WIN9, TOK7)

def resolve_block_size(block_size: int | None, model_max_length: int) -> int:
    """Default: the model maximum capped at 2048; an explicit size is capped at the model maximum."""
    if block_size is None:
        return min(model_max_length, 2048)
    return min(block_size, model_max_length)


def with_prefix_sum(df: DataFrame, order: Sequence[str], value: str, name: str,
                    width: int = DEFAULT_WIDTH, partition: Sequence[str] = (),
                    total: str | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order`` without a one-task window.

    With ``partition`` the sum restarts per partition (each a bounded batch);
    without it, order-preserving buckets of the first (integral) order column
    are summed on a small table and offset back, like ``with_global_index``.
    ``total`` adds the sum over the partition (or over everything).
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        d = df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
        if total:
            d = d.withColumn(total, F.sum(value).over(Window.partitionBy(*partition)).cast("long"))
        return d
    d = df.withColumn("_pb", F.floor(F.col(order[0]) / F.lit(width)).cast("long"))
    offs = bucket_offsets(d.groupBy("_pb").agg(F.sum(value).alias("_ps")), "_pb", "_ps", "_poff", total)
    w = Window.partitionBy("_pb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("_pin", F.coalesce(F.sum(value).over(w), F.lit(0)))
            .join(offs, "_pb").withColumn(name, (F.col("_poff") + F.col("_pin")).cast("long"))
            .drop("_pb", "_pin", "_poff"))


def pack_blocks(df: DataFrame, ids: str, block_size: int, order: Sequence[str],
                batch_rows: int | None = None, mask: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """WIN9: concatenate sequences, in a unique ``order`` (per batch of ``batch_rows`` rows, or globally), cut every
    ``block_size`` ids, drop the remainder.  Labels are reset to the ids (TOK7).

    ``sizes`` (``order``, ``_n``) may give the sequences' sizes where they are known without the sequences.

    Each row is sliced into the blocks its id range overlaps (no per-token
    explode); blocks are regrouped by (batch, block), each at most
    ``block_size`` ids.
    """
    b = block_size
    # Offsets come from keys and sizes alone; the sequences are joined to them once.
    d = df.select(*order, F.size(ids).alias("_n")) if sizes is None else sizes
    if batch_rows:
        d = with_global_index(d, order, "_ri")
        d = d.withColumn("batch", F.floor(F.col("_ri") / F.lit(batch_rows)).cast("long"))
        d = with_prefix_sum(d, ["_ri"], "_n", "_off", partition=["batch"], total="_tot").drop("_ri")
    else:
        d = with_prefix_sum(d, order, "_n", "_off", total="_tot").withColumn("batch", F.lit(0).cast("long"))
    d = df.select(*order, ids, *([mask] if mask else [])).join(d, list(order))
    d = d.withColumn("_usable", (F.floor(F.col("_tot") / F.lit(b)) * F.lit(b)).cast("long"))
    end = F.least(F.col("_off") + F.col("_n"), F.col("_usable"))
    d = d.filter(end > F.col("_off"))
    first = F.floor(F.col("_off") / F.lit(b))
    last = F.floor((end - 1) / F.lit(b))
    x = d.select("batch", "_off", "_n", "_usable", ids, *([mask] if mask else []),
                 F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * F.lit(b), F.col("_off")) - F.col("_off")
    hi = F.least((F.col("block") + 1) * F.lit(b), F.col("_off") + F.col("_n"), F.col("_usable")) - F.col("_off")
    pieces = [F.struct("_off", F.slice(ids, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("p")).alias("_pid")]
    if mask:
        pieces.append(F.struct("_off", F.slice(mask, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("p")).alias("_pm"))
    x = x.select("batch", "block", *pieces)
    aggs = [F.flatten(F.transform(F.array_sort(F.collect_list("_pid")), lambda s: s["p"])).alias("input_ids")]
    if mask:
        aggs.append(F.flatten(F.transform(F.array_sort(F.collect_list("_pm")), lambda s: s["p"])).alias("attention_mask"))
    out = x.groupBy("batch", "block").agg(*aggs)
    return out.withColumn("labels", F.col("input_ids"))
