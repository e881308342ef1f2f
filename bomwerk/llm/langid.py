"""Language identification by compression.

A text is compressed once for each language with a zstandard dictionary of raw text in
that language; the smallest result names the language. A text whose best two results
are about equal is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomwerk.llm import batches
from bomwerk.llm.tables import kept, stored

UNKNOWN = "und"
SAMPLE_DOCS = 128  # labelled documents fetched for each language, and of each so many characters from its middle
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 1 << 17  # the dictionary of a language is made of whole documents up to this size
MIN_MARGIN = 0.002  # best against second size, as a share of the second
LEVEL = 5
PIECE = 1 << 15  # bytes of a text that are compressed at once; what a dictionary saves on a frame is bounded
CARRIER_BYTES = 256  # of each dictionary, for texts that come out equal
STEEP = 50.0  # margin at which the score is 1 - 1/e: 2 %


def train(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary for each value of ``lang`` in ``labelled`` (doc_id, text, lang).

    The sample is bounded: of the documents with a letter, each of ``SAMPLE_DOCS`` hash
    buckets of a language gives the one with the lowest hash, cut to ``SAMPLE_CHARS``
    around its middle. Only hashes are aggregated, so a language with most of all rows
    costs no more than another.
    """
    digest = F.xxhash64("doc_id", "text")
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    middle = F.greatest(F.lit(0), F.floor((F.length("text") - SAMPLE_CHARS) / 2)).cast("int") + 1
    rows = rows.select("lang", F.substr("text", middle, F.lit(SAMPLE_CHARS)).alias("text"), digest.alias("digest"))
    chosen = rows.groupBy("lang", F.pmod("digest", F.lit(SAMPLE_DOCS)).alias("bucket")).agg(F.min("digest").alias("digest"))
    chosen = stored(chosen.select("lang", "digest"), "lang-sample")  # small, so Spark sends it to the texts and not these to it
    found = rows.join(chosen, ["lang", "digest"]).dropDuplicates(["lang", "digest"]).collect()
    contents: dict[str, bytes] = {}
    for row in sorted(found, key=lambda row: (row.lang, row.digest)):
        text = batches.plain(pa.array([row.text]))[0].as_py().encode()
        held = contents.get(row.lang, b"")
        if text and (not held or len(held) + len(text) < DICTIONARY_BYTES):
            contents[row.lang] = held + b" " + text
    return contents


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected beside all other columns.

    Whole texts, in lower case and without anything but letters, are compressed, long ones
    in pieces whose sizes add up, so that the margin does not shrink with the length. A null
    text and one without letters is ``und``, with score 0, and rejected; so is every
    text if there is no dictionary. Of equal sizes the language that sorts first wins,
    and the text is rejected. Columns with the names of the results are replaced.
    """
    columns = kept(docs, "lang_pred", "score", "rejected")
    rows = docs.select(*columns)
    schema = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)}).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(dictionaries)
        for batch in parts:
            for part in batches.slices(batch, text):
                found = [judge(body) for body in batches.plain(part.column(text)).to_pylist()]
                names, scores, rejected = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*columns, "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(run, schema)


def _judge(dictionaries: dict[str, bytes]):
    import math

    import zstandard

    compressors = []
    for lang, content in sorted(dictionaries.items()):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        compressors.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False)))
    # behind text that all languages have pieces of, a few more words cost what they are worth, without the cost of a frame
    carrier = b" ".join(content[:CARRIER_BYTES] for _, content in sorted(dictionaries.items()))
    bare = [len(packer.compress(carrier)) for _, packer in compressors]

    def weigh(raw: bytes) -> list[tuple[int, str]]:
        pieces = -(-len(raw) // PIECE)
        cuts = [len(raw) * n // pieces for n in range(pieces + 1)]
        parts = [raw[low:high] for low, high in zip(cuts, cuts[1:], strict=False)]
        sizes = sorted((sum(len(packer.compress(part)) for part in parts), lang) for lang, packer in compressors)
        if len(sizes) > 1 and sizes[0][0] == sizes[1][0]:
            behind = [carrier + b" " + part + b" " for part in parts]
            sizes = sorted((sum(len(packer.compress(part)) - before for part in behind), lang) for (lang, packer), before in zip(compressors, bare, strict=True))
        return sizes

    def judge(body: str) -> tuple[str, float, bool]:
        if not body or not dictionaries:
            return UNKNOWN, 0.0, True
        raw = body.encode()
        sizes = weigh(raw)
        best, lang = sizes[0]
        second = sizes[1][0] if len(sizes) > 1 else len(raw) + best
        margin = (second - best) / max(1, second)
        return lang, 1.0 - math.exp(-STEEP * margin), margin < MIN_MARGIN

    return judge


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to a fold, by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))
