"""The operators as queries over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import conversation_digests, format_windows
from .conversation_trie import numbered_turns, prefix_trie, with_shared_heads
from .decontamination import benchmark_leaks
from .exact_dedup import exact_duplicates
from .hard_negatives import mine_hard_negatives
from .html_extraction import extract_main_text
from .line_dedup import dedup_lines, near_duplicate_lines
from .ngram_join import near_duplicates
from .packing import pack_documents
from .quality_resampling import resample
from .secret_scan import scan_secrets, secret_digests
from .token_counts import token_counts
from .toxicity_chain import toxicity

#: Vocabularies lie beside the Python packages of every executor.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = build
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return build

    return register


@query(
    "op1_line_dedup",
    r"""
    with split as (
        select doc_id, string_split(coalesce(text, ''), chr(10)) as raws from documents
    ), raw as (
        select doc_id, unnest(raws) as raw, unnest(range(len(raws))) as line_no from split
    ), lines as (
        select *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from raw
    ), firsts as (
        select line, min(row(doc_id, line_no)) as seen from lines where line <> '' group by line
    ), sizes as (
        select *, unnest(list_distinct([(length(line) - 1) // 8 * 4, length(line) // 8 * 4, (length(line) + 1) // 8 * 4])) as part
        from firsts where length(line) >= 16
    ), parts as (
        select line, seen, part, 1 as side, left(line, part) as own from sizes
        union all
        select line, seen, part, 2, right(line, part) from sizes
    ), near as (
        select distinct a.line
        from parts a join parts b on a.part = b.part and a.side = b.side and a.own = b.own and b.seen < a.seen
        where abs(length(a.line) - length(b.line)) <= 1
            and (with recursive same(n) as (
                select 0 union all
                select n + 1 from same where n < length(a.line) and substr(a.line, n + 1, 1) = substr(b.line, n + 1, 1)
            ) select substr(a.line, max(n) + 1 + (length(a.line) >= length(b.line))::int)
                = substr(b.line, max(n) + 1 + (length(b.line) >= length(a.line))::int) from same)
    ), kept as (
        select l.*, l.line = '' or (f.seen = row(l.doc_id, l.line_no) and n.line is null) as stays
        from lines l left join firsts f using (line) left join near n using (line)
    )
    select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped,
        coalesce(string_agg(raw, chr(10) order by line_no) filter (stays), '') as text
    from kept group by doc_id
    """,
)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the lines that stay."""
    return dedup_lines(table(spark, folder, "documents"))


@query(
    "op1_line_decisions",
    r"""
    with split as (
        select doc_id, string_split(coalesce(text, ''), chr(10)) as raws from documents
    ), raw as (
        select doc_id, unnest(raws) as raw, unnest(range(len(raws))) as line_no from split
    ), lines as (
        select *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from raw
    ), firsts as (
        select line, min(struct_pack(d := doc_id, n := line_no)) as seen from lines where line <> '' group by line
    ), sizes as (
        select *, unnest(list_distinct([(length(line) - 1) // 8 * 4, length(line) // 8 * 4, (length(line) + 1) // 8 * 4])) as part
        from firsts where length(line) >= 16
    ), parts as (
        select line, seen, part, 1 as side, left(line, part) as own from sizes
        union all
        select line, seen, part, 2, right(line, part) from sizes
    ), near as (
        select a.line, min(b.seen) as near_seen
        from parts a join parts b on a.part = b.part and a.side = b.side and a.own = b.own and b.seen < a.seen
        where abs(length(a.line) - length(b.line)) <= 1
            and (with recursive same(n) as (
                select 0 union all
                select n + 1 from same where n < length(a.line) and substr(a.line, n + 1, 1) = substr(b.line, n + 1, 1)
            ) select substr(a.line, max(n) + 1 + (length(a.line) >= length(b.line))::int)
                = substr(b.line, max(n) + 1 + (length(b.line) >= length(a.line))::int) from same)
        group by a.line
    )
    select doc_id, line_no::int as line_no, coalesce(near_seen.d, seen.d) as kept_doc_id, coalesce(near_seen.n, seen.n)::int as kept_line_no
    from lines join firsts using (line) left join near using (line)
    where near_seen is not null or seen <> struct_pack(d := doc_id, n := line_no)
    """,
)
def line_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that go, and what they repeat."""
    return near_duplicate_lines(table(spark, folder, "documents"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


@query("op3_quality_resampling")
def quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """The documents sampled, one row each."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), TOKENIZER, with_ids=False)


@query("op5_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(scan_secrets(table(spark, folder, "documents")))


@query("op6_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts hold the control strings of the template.
    control = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    return conversation_digests(format_windows(conversations.union(spark.createDataFrame(rows, conversations.schema))))


@query("op7_toxicity_chain")
def toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The documents found toxic, one row each. Low quality comes before toxicity in the chain."""
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity(table(spark, folder, "documents"), labels, ["low_quality", "toxic"]).filter("is_toxic")


@query("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op9_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(
    "op10_exact_dedup",
    r"""
    with d as (
        select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
        from documents
    ), g as (
        select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
    """,
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


@query("op11_token_counts")
def token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), BYTE_TOKENIZER)


@query(
    "op12_conversation_trie",
    r"""
    with own as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
            row_number() over (
                partition by conv_id
                order by turn nulls first, unhex(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))
            ) as place
        from conversations where conv_id is not null
    ), heads as (
        -- The CRC-32 of the id's digits, bit by bit.
        select conv_id, conv_id - conv_id % 100 as first,
            xor(4294967295, list_reduce(
                list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)),
                lambda crc, byte: list_reduce(
                    list_prepend(xor(crc, byte), range(8)),
                    lambda r, _: xor(r // 2, case when r % 2 = 1 then 3988292384 else 0 end)
                )
            )) % 6 as h
        from (select distinct conv_id from own)
    ), turns as (
        select h.conv_id, o.place, role, text from heads h join own o on o.conv_id = h.first and o.place <= h.h
        union all
        select conv_id, 1000 + o.place, role, text from heads h join own o using (conv_id) where o.place > h.h
    ), rebuilt as (
        select conv_id, role, text, row_number() over (partition by conv_id order by place) as depth from turns
    ), prefixes as (
        select conv_id, depth, text,
            sha256(string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by depth)) as prefix
        from rebuilt
        union all
        select conv_id, 0, '', '' from heads
    ), named as (
        select *, min(conv_id) over same as node, count(*) over same as n_convs, max(depth) over (partition by conv_id) as length
        from prefixes window same as (partition by depth, prefix)
    ), members as (
        select *, lag(node) over (partition by conv_id order by depth) as parent from named
    ), nodes as (
        select node, depth, any_value(parent) as parent, any_value(n_convs) as n_convs, any_value(text) as text,
            count(*) filter (length = depth) as n_ends,
            coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth), '') as ends
        from members group by node, depth
    ), sums as (
        -- A node's subtree: the nodes named by its members, from its depth on.
        select m.node, m.depth, sum((n.n_ends = n.n_convs)::int) as n_leaves, sum((n.n_convs - 1) * length(n.text)) as saved
        from members m join nodes n on n.node = m.conv_id and n.depth >= m.depth
        group by m.node, m.depth
    ), children as (
        select parent, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all
    )
    select n.node as conv_id, n.depth, n.parent as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children,
        s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
    from nodes n join sums s using (node, depth) left join children c on c.parent = n.node and c.depth = n.depth
    """,
)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of all conversations, rebuilt to share their beginnings."""
    return prefix_trie(*with_shared_heads(numbered_turns(table(spark, folder, "conversations"))))


@query(
    "op13_hard_negatives",
    """
    with v as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)) as e
        from embeddings
        where label is not null and embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scores as (
        select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same, list_dot_product(a.e, r.e)::bigint as score
        from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
    ), positives as (
        select anchor_id, id as positive_id, score as positive_score from scores where same
        qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
    )
    select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
        id as negative_id, positive_score, score as negative_score
    from positives p join scores s on s.anchor_id = p.anchor_id and not same
        and 100 * score between 30 * positive_score and 90 * positive_score
    qualify rank <= 10
    """,
)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are off by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", label)
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
