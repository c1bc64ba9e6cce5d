"""Line dedup by winnowing over line hashes.

Lines that hold more than white space form each document's sequence. Windows of ``run`` lines choose the smallest
line hash in them as fingerprint, so every repeated run of that length or more shares fingerprints at equal places.
Fingerprint positions are joined across the corpus (repeats.py), matches extend both ways over the windows around the
fingerprint, and overlapping matches unite to the whole run. All but the first place of a run, in order of (doc_id,
line), is deleted. A single line of ``long_words`` words or more is a run by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import rows_bytes, table
from stackloom.llm.repeats import Repeats, ddl

#: Lines of the shortest run that goes when it repeats.
RUN = 2
#: Words that make one line a run.
LONG_WORDS = 50

_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def frame(run: int = RUN, long_words: int = LONG_WORDS) -> Repeats:
    return Repeats("line", run, max(1, run // 2), "place", long_words=long_words)


def remove_runs(documents: DataFrame, run: int = RUN, long_words: int = LONG_WORDS, keep: tuple[str, ...] = (), text: bool = True) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_lines, n_removed, kept_sha256, kept, and the columns in keep.

    Lines end at \\n and are compared byte for byte; n_lines counts all, blank ones too, which never go by themselves.
    kept joins the lines left by \\n. Null texts count as empty (one blank line); rows with a null doc_id are only
    compared within themselves and with rows that have one, after which they come; of rows that repeat a doc_id neither
    removes lines of the other; columns not in keep are ignored. text=False leaves kept null.
    """
    rep = frame(run, long_words)

    def apply(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _OUT}
            for doc, body, gone in zip(batch.column(0).to_pylist(), rows_bytes(batch.column(1)), batch.column(2 + len(keep)).to_pylist()):
                lines = body.split(b"\n")
                kept = lines
                if gone:
                    solid = [i for i, x in enumerate(lines) if x.strip(b" \t\n\r\x0b\x0c")]
                    hit = set(np.array(solid)[rep.mask(len(solid), gone)].tolist())
                    kept = [x for i, x in enumerate(lines) if i not in hit]
                joined = b"\n".join(kept)
                for k, v in zip(out, (doc, len(lines), len(lines) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if text else None)):
                    out[k].append(v)
            extra = pa.schema([batch.schema.field(2 + i).with_name(k) for i, k in enumerate(keep)])
            done = table(out, _OUT)
            yield pa.RecordBatch.from_arrays([*done.columns, *batch.columns[2 : 2 + len(keep)]], schema=pa.schema([*_OUT, *extra]))

    safe = {k: f"k{i}" for i, k in enumerate(keep)}
    joined = rep.removals(documents.select("doc_id", "text", *[F.col(f"`{k}`").alias(v) for k, v in safe.items()]), list(safe.values()))
    kinds = "".join(f", `{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return joined.mapInArrow(apply, ddl(_OUT) + kinds)


def op3_lines(spark, sf_dir: str) -> DataFrame:
    return remove_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False).drop("kept")


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), f AS (
  SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS below, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS wide FROM f
), r AS (
  SELECT *, below IS NOT NULL AND row_number() OVER (PARTITION BY line, below ORDER BY doc_id, i) > 1 AS pair,
    wide AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS single FROM w
), g AS (
  SELECT doc_id, pos, pair OR single OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM r
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id, pos) GROUP BY l.doc_id
"""
