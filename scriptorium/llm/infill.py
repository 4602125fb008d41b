"""Fill-in-the-middle transformation: texts cut at token borders into prefix, middle and suffix, and put in another order.

The tokenizers library's ``Split`` pre-tokenizer isolates the matches of a fixed
pattern and gives their code-point offsets, with no vocabulary and no training.
The number of offsets is the number of tokens n; two ranks between 0 and n, drawn
by a hash of the document's id, pick the offsets where a text is cut.  The rest is
built-in functions: draws, slices, markers and the way back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

#: The tokens, and what marks prefix, suffix and middle.
TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80

_CUTS = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])


def token_ends(split, text: str) -> np.ndarray:
    """The code-point offset after each token."""
    return np.fromiter((end for _, (_, end) in split.pre_tokenize_str(text)), np.int64) if text else np.zeros(0, np.int64)


def _cuts(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    """n, and the offsets of the smaller and the larger of the ranks one % (n + 1) and other % (n + 1)."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(TOKENS), behavior="isolated")
    out = []
    for t, a, b in zip(text, one.to_pylist(), other.to_pylist()):
        ends = token_ends(split, t.as_py())
        n = len(ends)
        low, high = sorted((a % (n + 1), b % (n + 1)))
        out.append({"n": n, "first": int(ends[low - 1]) if low else 0, "second": int(ends[high - 1]) if high else 0})
    return pa.array(out, _CUTS)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of the seed and a key; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infill(documents: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """documents(doc_id, text, ...) as doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``form`` is plain (output is the text; no cut), psm (prefix, suffix, middle) or spm
    (suffix, prefix, middle).  Plain are empty texts, texts that hold a marker and the
    share beyond ``fim_percent``; of the others ``spm_percent`` are spm.  A null text is
    empty.  Rows with the same doc_id draw the same; a null doc_id draws as an empty one.
    A text of blanks is one token; a very long text is one row's work, whole.  An empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    bounded_batches(documents.sparkSession)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    text = F.col("text")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    d = d.select("doc_id", "text", form.alias("form"), F.arrow_udf(_cuts, "struct<n:long,first:long,second:long>")("text", "h1", "h2").alias("cut"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    suffix = F.substring(text, second + 1, F.lit(2**31 - 1))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return d.select(
        "doc_id", F.col("cut.n").alias("n"), "form",
        F.when(cut, F.col("cut.first")).alias("prefix_chars"), F.when(cut, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone.

    Texts with a marker stay plain, and no end of a slice makes one together with the
    marker after it, so the first of each marker is the one that was set.
    """

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(one) + 1), F.lit(2**31 - 1))
        a = F.substring_index(rest, two, 1)
        rest = F.substring(rest, F.length(a) + len(two) + 1, F.lit(2**31 - 1))
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substring(rest, F.length(b) + len(MIDDLE) + 1, F.lit(2**31 - 1))

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
