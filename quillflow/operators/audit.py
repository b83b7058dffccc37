"""Auditing contracts: classify, split, retrieve, judge, report."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

# Keywords of the fields of law.
DOMAIN_KEYWORDS = {
    "Lao động": [
        "người lao động", "hợp đồng lao động", "tiền lương", "thời giờ làm việc", "nghỉ phép", "bảo hiểm xã hội", "sa thải", "thôi việc", "nội quy lao động",
        "thỏa ước lao động", "tai nạn lao động", "bệnh nghề nghiệp", "người sử dụng lao động", "chấm dứt hợp đồng lao động",
    ],
    "Doanh nghiệp": [
        "góp vốn", "cổ phần", "cổ đông", "hội đồng quản trị", "đại hội đồng cổ đông", "vốn điều lệ", "liên doanh", "sáp nhập", "mua lại", "thành viên công ty",
        "hội đồng thành viên", "giám đốc điều hành", "cổ tức", "phần vốn góp",
    ],
    "Thương mại": [
        "mua bán hàng hóa", "cung ứng dịch vụ", "đại lý thương mại", "nhượng quyền thương mại", "trung gian thương mại", "phân phối", "xuất khẩu", "nhập khẩu",
        "giao nhận hàng", "thanh toán thương mại", "tín dụng thư", "hàng hóa", "thương nhân", "hoạt động thương mại",
    ],
    "Dân sự": [
        "hợp đồng dân sự", "mua bán tài sản", "cho thuê tài sản", "vay mượn", "thừa kế", "tặng cho", "ủy quyền", "bảo lãnh", "thế chấp", "cầm cố",
        "quyền sử dụng đất", "bất động sản", "hợp đồng dân dụng",
    ],
}
DEFAULT_DOMAIN = "Thương mại"
REQUIRED = ("clause", "violation", "reference_law", "suggested_fix")
CLAUSE = r"(?imud)(?=^Điều\s+\d+[.:\-\s])"


def keyword_scores(text: t.Text, keywords: dict[str, list[str]]) -> Column:
    """Array of (``score``, ``domain``): how many keywords of each domain a text has, in the table's order.  Accents count."""

    def scores(lowered: Column) -> Column:
        one = lambda words: sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0))
        return F.array(*(F.named_struct(F.lit("score"), one(words), F.lit("domain"), F.lit(name)) for name, words in keywords.items()))

    return t.let(F.lower(t.text(text)), scores)


def classify(text: t.Text, keywords: dict[str, list[str]] = DOMAIN_KEYWORDS) -> Column:
    """Domain with two keywords or more and at least twice as many as the next; null if it isn't clear."""

    def clear(ranked: Column) -> Column:
        # Ascending by score, so the last is the winner; two with the same score are never clear.
        top, second = F.element_at(ranked, -1), (F.element_at(ranked, -2)["score"] if len(keywords) > 1 else F.lit(0))
        return F.when((top["score"] >= 2) & (top["score"] >= 2 * second), top["domain"])

    return t.let(F.array_sort(keyword_scores(text, keywords)), clear)


def clauses(text: t.Text) -> Column:
    """Clauses of a contract: cut before each article heading; with fewer than two, at blank lines; never none."""
    some = lambda parts: F.filter(F.transform(parts, t.strip), lambda x: x != "")
    by_heading, by_blank = some(F.split(t.text(text), CLAUSE)), some(F.split(t.text(text), r"(?U)\n\s*\n"))
    return F.when(F.size(by_heading) >= 2, by_heading).when(F.size(by_blank) > 0, by_blank).otherwise(F.array(t.strip(text)))


def parsed_domain(answer: t.Text) -> Column:
    """``domain`` of a model's answer in JSON; the default if there is none to read."""
    return F.coalesce(F.get_json_object(t.col(answer), "$.domain"), F.lit(DEFAULT_DOMAIN))


def parsed_clauses(answer: t.Text) -> Column:
    """``clauses`` of a model's answer in JSON; null if there are none to read."""
    read = F.from_json(F.get_json_object(t.col(answer), "$.clauses"), "array<string>")
    return F.when(F.size(read) > 0, read)


FEW_CLAUSES = 3


def routed(contracts: DataFrame, ask: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``domain``, ``clauses`` and ``error`` of every contract.

    Blank contracts are errors.  ``ask`` adds a model's ``answer`` to contracts,
    for a ``"domain"`` that keywords leave open and for ``"clauses"`` where
    patterns find fewer than three; an answer that can't be read changes
    nothing.  Only such contracts go to it: the frame is parted, since a
    function inside a CASE would run for all rows.
    """
    own = contracts.columns
    read = contracts.withColumns({"error": F.when(t.strip("text") == "", "contract is empty"), "domain": classify("text"), "clauses": F.when(t.strip("text") != "", clauses("text"))})
    fields = [*own, "error", "domain", "clauses"]

    def asked(frame: DataFrame, wanted: Column, about: str, change: Callable[[], Column]) -> DataFrame:
        if ask is None:
            return frame
        wanted = F.col("error").isNull() & wanted
        answered = ask(frame.filter(wanted), about).withColumn(about, change()).select(*fields)
        return frame.filter(~F.coalesce(wanted, F.lit(False))).select(*fields).unionByName(answered)

    read = asked(read, F.col("domain").isNull(), "domain", lambda: parsed_domain("answer"))
    read = asked(read, F.size("clauses") < FEW_CLAUSES, "clauses", lambda: F.coalesce(parsed_clauses("answer"), F.col("clauses")))
    return read.withColumn("domain", F.when(F.col("error").isNull(), F.coalesce("domain", F.lit(DEFAULT_DOMAIN))))


# -------------------------------------------------------------------- retrieval

BLOCK = 4096


def _blocks(vectors: DataFrame, id_: str, vector: str, prefix: str) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                matrix = np.stack(part.column(vector).to_numpy(zero_copy_only=False)).astype("<f8")
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = matrix / np.where(norms > 0, norms, 1)
                yield pa.RecordBatch.from_pydict({f"{prefix}_ids": pa.array([part.column(id_).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), f"{prefix}_m": pa.array([matrix.tobytes()], pa.binary())})

    return vectors.select(id_, vector).filter(F.col(id_).isNotNull() & (F.size(vector) > 0)).mapInArrow(run, f"{prefix}_ids binary, {prefix}_m binary")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``found_id``, ``similarity``: the ``k`` vectors nearest by cosine to each query, itself left out; ties by id.

    Queries and corpus meet block by block: a block pair is one matrix product
    that leaves ``k`` rows for each query, so memory is that of two blocks and
    no pair of vectors is ever a row.
    """
    pairs = _blocks(corpus, id_, vector, "c").crossJoin(_blocks(queries, id_, vector, "q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c_ids, c_m, q_ids, q_m in zip(*(batch.column(x).to_pylist() for x in ("c_ids", "c_m", "q_ids", "q_m")), strict=True):
                ci, qi = np.frombuffer(c_ids, dtype="<i8"), np.frombuffer(q_ids, dtype="<i8")
                cm, qm = np.frombuffer(c_m, dtype="<f8").reshape(len(ci), -1), np.frombuffer(q_m, dtype="<f8").reshape(len(qi), -1)
                scores = qm @ cm.T
                scores[qi[:, None] == ci[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ci, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                fine = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, order.shape[1])[fine.ravel()]), pa.array(ci[order][fine]), pa.array(best[fine])], ["query_id", "found_id", "similarity"])

    found = pairs.mapInArrow(run, "query_id long, found_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "found_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def unique_context(results: DataFrame, keys: list[str]) -> DataFrame:
    """Sections of each contract's context (``position`` from 1, ``result``): results whose first 100 characters came before go; the rest keep their clause's number."""
    prefix = F.md5(F.left("result", F.lit(100)))
    kept = results.filter(t.text("result") != "").groupBy(*keys, prefix.alias("_key")).agg(F.min(F.struct("position", "result")).alias("_first"))
    section = F.concat(F.lit("### Điều khoản "), F.col("_first.position"), F.lit("\n"), F.col("_first.result"), F.lit("\n"))
    return kept.select(*keys, F.col("_first.position").alias("position"), section.alias("section"))


def section_texts(context: t.Text, cap: int = 3000) -> Column:
    """Sections of a whole context, cut before each heading of theirs, stripped and capped."""
    parts = F.split(t.text(context), r"(?=### Điều khoản \d)")
    return F.transform(F.filter(F.transform(parts, t.strip), lambda x: x != ""), lambda x: F.left(x, F.lit(cap)))


def whole_context(sections: DataFrame, keys: list[str]) -> DataFrame:
    """``context`` of each contract: its sections in their order, one line apart."""
    parts = F.array_sort(F.collect_list(F.struct("position", "section")))
    return sections.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["section"]), "\n").alias("context"))


def hybrid_context(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 5, chars: int = 1000) -> DataFrame:
    """``query_id`` and ``result``: texts of the ``k`` nearest chunks of each query, then of the chunks that the graph links to them.

    ``queries`` (``vec_id``, ``embedding``) are held against ``vectors``;
    ``chunks`` (``vec_id``, ``text``) has the texts by key, ``edges`` (``a``,
    ``b``) the graph.  Nearer chunks come first; of a chunk found both ways the
    first place counts.  A query without any result has an empty one.
    """
    near = top_k(queries, vectors, k).select("query_id", "found_id", F.col("rank").cast("int").alias("place"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = near.join(both, near.found_id == both.a).select("query_id", F.col("b").alias("found_id"), (F.col("place") + k).alias("place")).filter("found_id <> query_id")
    every = near.unionByName(linked).groupBy("query_id", "found_id").agg(F.min("place").alias("place"))
    # Of the neighbours as many as of the nearest.
    ranked = every.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "found_id"))).filter(F.col("r") <= 2 * k)
    texts = ranked.join(chunks.select(F.col("vec_id").alias("found_id"), "text"), "found_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n")
    found = texts.groupBy("query_id").agg(F.left(joined, F.lit(chars)).alias("result"))
    return queries.select(F.col("vec_id").alias("query_id")).join(found, "query_id", "left").withColumn("result", F.coalesce("result", F.lit("")))


def context_for_clauses(clauses_: DataFrame, sections: DataFrame, keys: list[str], cap: int = 3000, by_heading: bool = False) -> DataFrame:
    """``clauses_`` (``position`` from 1) and the ``context`` of each.

    The i-th clause gets the i-th section that is left, which is another
    clause's once a section was dropped; ``by_heading`` gives it its own.
    """
    place = F.col("position") if by_heading else F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    own = sections.withColumn("position", place.cast("int")).withColumn("context", F.left(t.strip("section"), F.lit(cap))).select(*keys, "position", "context")
    return clauses_.join(own, [*keys, "position"], "left").withColumn("context", F.coalesce("context", F.lit("")))


# --------------------------------------------------------------------- findings


def first_list(raw: str | None) -> list:
    """The findings in a model's answer: a list, an object's ``findings``, or the first list in the text; brackets in strings count."""
    raw = raw or ""
    try:
        data = json.loads(raw)
        return data if isinstance(data, list) else data.get("findings", []) if isinstance(data, dict) else []
    except ValueError:
        pass
    start, depth = raw.find("["), 0
    for i in range(start, len(raw) if start >= 0 else start):
        depth += (raw[i] == "[") - (raw[i] == "]")
        if depth == 0:
            try:
                return json.loads(raw[start : i + 1])
            except ValueError:
                return []
    return []


def findings(answers: DataFrame, raw: str = "answer") -> DataFrame:
    """``answers`` and ``finding`` (four texts), one row for each finding that has all required keys."""
    from pyspark.sql.types import ArrayType, MapType, StringType

    @F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
    def parse(values: pd.Series) -> pd.Series:
        text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
        return values.map(lambda v: [{k: text(x) for k, x in f.items()} for f in first_list(v) if isinstance(f, dict)])

    each = answers.withColumn("_f", F.explode_outer(parse(raw))).filter("_f is not null")
    full = each.filter(F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), F.map_keys("_f"))) == 0)
    return full.withColumn("finding", F.struct(*(F.col("_f")[k].alias(k) for k in REQUIRED))).drop("_f")


def judged(found: DataFrame, keys: list[str], failed: str = "failed", position: str = "position") -> DataFrame:
    """``confidence`` and ``error`` of each contract, from one row or more for each clause (``position``): one for each finding, with its ``reference_law``, or one with a null.

    Confidence is the share of findings that name a law.  If more than half of
    the clauses failed, it is 0 and an error; a clause counts once, however much
    was found in it.
    """
    clause = found.groupBy(*keys, position).agg(F.bool_or(failed).alias("_bad"), F.count("reference_law").alias("_any"), F.count_if(F.col("reference_law") != "").alias("_named"))
    n, bad, named, any_ = F.count(F.lit(1)), F.count_if("_bad"), F.sum("_named"), F.sum("_any")
    broken = bad > F.floor(n / 2)
    return clause.groupBy(*keys).agg(
        n.alias("clauses"), bad.alias("failed"), any_.alias("findings"),
        F.when(broken, 0.0).otherwise(F.coalesce(named / F.nullif(any_, F.lit(0)), F.lit(0.0))).alias("confidence"),
        F.when(broken, F.concat(bad.cast("string"), F.lit("/"), n.cast("string"), F.lit(" clauses failed"))).alias("error"),
    )


def report(domain: Column, confidence: Column, n_clauses: Column, found: Column, error: Column, now: str) -> Column:
    """Markdown report of a contract; ``found`` is its array of findings in order."""
    n, line = F.size(found), lambda *x: F.concat_ws("", *(F.lit(y) if isinstance(y, str) else y for y in x))
    stub = F.when(confidence == 0.0, " _(STUB — cần OPENAI_API_KEY)_").otherwise("")
    summary = (
        F.when(error.isNotNull(), line("**Lỗi pipeline:** ", error))
        .when(n == 0, "Không phát hiện vi phạm nào. _(Lưu ý: đang chạy ở chế độ STUB — cần OPENAI_API_KEY để phân tích thực sự)_")
        .otherwise(line("Đã kiểm tra **", n_clauses.cast("string"), "** điều khoản, phát hiện **", n.cast("string"), "** mục cần xem xét", stub, "."))
    )

    def entry(f: Column, i: Column) -> Column:
        law = F.coalesce(t.present(f["reference_law"]), F.lit("_(chưa xác định)_"))
        return line("### Vi phạm ", (i + 1).cast("string"), "\n- **Điều khoản:** ", F.left(t.text(f["clause"]), F.lit(120)), "\n- **Vi phạm:** ", t.text(f["violation"]), "\n- **Căn cứ pháp lý:** ", law, "\n- **Khuyến nghị sửa đổi:** ", t.text(f["suggested_fix"]), "\n")

    details = F.when(n == 0, "_(Không có vi phạm nào được phát hiện)_").otherwise(F.array_join(F.transform(found, entry), "\n"))
    foot = line("*Lĩnh vực: **", F.coalesce(domain, F.lit("Chưa xác định")), "** | Điểm tin cậy: ", F.format_string("%.2f", confidence), " | Điều khoản: ", n_clauses.cast("string"), " | Vi phạm: ", n.cast("string"), f" | {now}*")
    return line(
        "# Báo cáo Kiểm toán Hợp đồng\n\n## Tóm tắt\n\n", summary, "\n\n## Chi tiết vi phạm\n\n", details, "\n## Khuyến nghị chung\n\n",
        "_(Xem chi tiết từng vi phạm ở trên. Cần OPENAI_API_KEY để có khuyến nghị tổng hợp từ AI.)_\n\n---\n", foot,
    )
