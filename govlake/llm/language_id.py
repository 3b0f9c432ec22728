"""Language ID by compression: encode a text with each language's zstandard raw-content dictionary, take the smallest.

The dictionaries are cut from a bounded sample of labelled texts (`sample_bytes` a language). Each whole text is
encoded in segments of `SEGMENT` bytes, each on its own, so that the dictionary and not the text's own past
decides, however long the text is. The sizes of the segments are added.

Before that, letters are lower-cased and every run of other characters becomes one blank, so that case,
decoration and numbers weigh nothing; zstandard may match three bytes (its fast levels need more).

Defined cases: a null text or one without a letter is `und` with score 0 and rejected. Equal sizes go to the
language that comes first by name. Texts of any length are encoded whole. An empty table gives no rows. Rows that repeat are judged alike; other columns are never read. With no
labelled text at all every row is `und`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a segment; bytes that a text counts as at least in its score.
SEGMENT, LEAST = 4096, 24
MOST_LANGUAGES = 1_000
UNKNOWN = "und"


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", sample_bytes: int = 32_768, piece: int = 1_024) -> dict[str, bytes]:
    """language -> dictionary of at most sample_bytes, from labelled rows whose lang and text are not null.

    One aggregate over the distinct hashes of the texts of each language, which tasks combine before they shuffle 16
    bytes a text, sums the bytes of the language without its copies; then about as many distinct texts as fill the
    dictionary twice are drawn by that hash, each giving at most `piece` characters from a place in it that another hash chooses. What reaches the driver is languages (at most MOST_LANGUAGES, else an error) x 2 x sample_bytes.
    """
    start = 1 + F.pmod(F.xxhash64(text, F.lit(18)), F.greatest(F.length(text) - piece + 1, F.lit(1)))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text, F.lit(17)).alias("place"), F.col(text).substr(start.cast("int"), F.lit(piece)).alias("text"))
    place = F.col("place")
    texts = rows.groupBy("lang", "place").agg(F.max(F.octet_length("text")).alias("bytes"))
    sizes = texts.groupBy("lang").agg(F.sum("bytes").alias("bytes")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return {}
    shares = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(2.0 * sample_bytes / max(r.bytes, 1)))])
    drawn = rows.where(F.pmod(place, F.lit(1 << 30)) / float(1 << 30) < F.element_at(shares, F.col("lang"))).dropDuplicates(["lang", "place", "text"])
    out: dict[str, bytes] = defaultdict(bytes)
    for row in sorted(drawn.toLocalIterator(), key=lambda r: (r.lang, r.place, r.text)):
        if len(out[row.lang]) < sample_bytes:
            out[row.lang] += folded(row.text).encode() + b"\n"
    return {k: v[:sample_bytes] for k, v in out.items()}


def folded(text: str) -> str:
    """Lower case, with one blank for each run of characters that are no letters."""
    return re.sub(r"[\W\d_]+", " ", text.lower())


def _compressors(model: dict[str, bytes]) -> list:
    """(language, function that compresses with its dictionary), by name."""
    import zstandard

    how = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=3, window_log=17, hash_log=15, chain_log=15, search_log=4, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    made = []
    for name, content in sorted(model.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        made.append((name, zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress))
    return made


def judge(text: str | None, compressors: list, has_letter) -> tuple[str, float, float]:
    """Language, score from 0 to 1, and the margin: by how much of the second size the best is smaller."""
    if text is None or not compressors or not has_letter(text):
        return UNKNOWN, 0.0, 0.0
    data = folded(text).encode()
    pieces = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
    sizes = [sum([len(f(p)) for p in pieces]) for _, f in compressors]
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    if len(order) == 1:
        return compressors[0][0], 1.0, 1.0
    best, second = sizes[order[0]], sizes[order[1]]
    bits = 8.0 * math.log(2) / math.sqrt(max(len(data), LEAST))
    score = 1.0 / sum([math.exp(-min(700.0, bits * (s - best))) for s in sizes])
    return compressors[order[0]][0], score, (second - best) / max(second, 1)


def judgement(spark: SparkSession, model: dict[str, bytes], least_margin: float = 0.002) -> Callable[[Column], Column]:
    """A function of a text column: struct(lang_pred, score, margin, rejected). Only that column goes through Python."""
    shared = spark.sparkContext.broadcast(dict(model))  # languages x sample_bytes

    @F.pandas_udf("lang_pred string, score double, margin double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        compressors, has_letter = _compressors(shared.value), regex.compile(r"\p{L}").search
        for texts in batches:
            yield pd.DataFrame([judge(t, compressors, has_letter) for t in texts], columns=["lang_pred", "score", "margin"])

    once = run.asNondeterministic()  # so that a filter on its result does not run it again

    def of(text: Column) -> Column:
        return F.transform(F.array(once(text)), lambda j: F.struct(j["lang_pred"].alias("lang_pred"), j["score"].alias("score"), j["margin"].alias("margin"), ((j["lang_pred"] == UNKNOWN) | (j["margin"] < least_margin)).alias("rejected")))[0]

    return of


def classify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text: str = "text", least_margin: float = 0.002) -> DataFrame:
    """(id_col, lang_pred, score, margin, rejected) for each row; rejected: `und`, or the margin is below least_margin."""
    return docs.select(F.col(id_col), judgement(docs.sparkSession, model, least_margin)(F.col(text)).alias("judged")).select(id_col, "judged.*")
