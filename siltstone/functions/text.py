"""Column functions over text: cleaning, tokens, extraction, classification. All but NFC are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values that results depend on ----------------------------------------------------------
DASHES_AND_QUOTES = ("–—“”‘’ ​﻿", "--\"\"'' ")  # the last two are deleted
ARTICLE, CHAPTER, SECTION = "Điều", "Chương", "Mục"
#: Injection patterns in order, with their categories.
INJECTION = (
    (r"\bignore\s+(all\s+)?(previous|prior|above)\b", "role_override"),
    (r"\byou\s+are\s+now\b", "role_override"),
    (r"\bact\s+as\s+(if\s+you\s+(are|were)|a\s+)", "role_override"),
    (r"\bpretend\s+(you\s+are|to\s+be)\b", "role_override"),
    (r"\bdan\b.*\bmode\b|\bdo\s+anything\s+now\b", "role_override"),
    (r"\bdisregard\s+(all\s+)?(your\s+)?(instructions?|rules?|guidelines?)\b", "instruction_override"),
    (r"\bforget\s+(everything|all)\s+(you\s+)?(know|were)\b", "instruction_override"),
    (r"\bnew\s+instructions?\s*:", "instruction_override"),
    (r"\bsystem\s+prompt\b", "instruction_override"),
    (r"\bprint\s+(your\s+)?(system\s+)?prompt\b", "prompt_leakage"),
    (r"\brepeat\s+(after\s+me|your\s+(system|instructions?))\b", "prompt_leakage"),
    (r"\bwhat\s+(are|were)\s+your\s+(instructions?|system\s+prompt|rules?)\b", "prompt_leakage"),
    (r"b[oỏ]\s+qua\s+(h[uướ]?[ơờ]?ng\s+d[aẫ][ấ]n|quy\s+t[aắ][cắ])", "role_override_vi"),
    (r"gi[aả]\s+v[oờ][ờ]\s+nh[uư]\s+b[aạ][nạ]\s+l[aà]", "role_override_vi"),
    (r"b[aâ]y\s+gi[oờ]\s+b[aạ][nạ]\s+l[aà]", "role_override_vi"),
)
VERBS = r"\b(answer|respond|tell\s+me|give\s+me|show\s+me|output|write|generate|produce)\b"
SELF = r"\b(yourself|your\s+instructions?|your\s+prompt|your\s+system|your\s+rules?|your\s+training)\b"
HOMOGLYPHS = r"[Ѐ-ӿͰ-Ͽ]"
REFUSALS = (
    r"không\s+(?:tìm\s+thấy|có\s+thông\s+tin|có\s+dữ\s+liệu)",
    r"ngoài\s+phạm\s+vi",
    r"chưa\s+có\s+trong\s+(?:cơ\s+sở|corpus|dữ\s+liệu)",
    r"không\s+thể\s+(?:trả\s+lời|cung\s+cấp)",
    r"thông\s+tin\s+(?:này\s+)?chưa\s+có",
    r"không\s+(?:tìm|tra)\s+cứu\s+được",
    r"vượt\s+quá\s+phạm\s+vi",
    r"tài\s+liệu\s+(?:này\s+)?chưa\s+được\s+(?:cập\s+nhật|tích\s+hợp|nạp)",
    r"i\s+don.t\s+have",
    r"not\s+(?:found|available)\s+in",
)
CITED = r"\[(?:\d+|Điều\s+\d+|Khoản\s+\d+|[A-ZĐÀÁẢÃẠĂẮẶẴẲÂẤẦẨẪẬ][^\]]{2,60})\]"
OUT_OF_CORPUS = "câu hỏi"
STOPWORDS = ("là", "của", "và", "có", "được", "cho", "trong", "một", "các", "những", "này")
#: Intents in order, with their phrases; the last one also asks for a digit.
INTENTS = (
    ("compare", ("so sánh", "khác nhau", "giống nhau", "phân biệt")),
    ("summarize", ("tóm tắt", "tóm lược", "nội dung chính")),
    ("report", ("báo cáo", "xuất pdf", "tổng hợp")),
    ("compliance_check", ("có được", "có đủ điều kiện", "có bị", "có đạt", "quá", "vượt quá")),
)
#: Slug prefixes in order, with the document type.
DOC_TYPES = (
    ("thong-tu-lien-tich-", "thong_tu_lt"), ("bo-luat-", "bo_luat"), ("phap-lenh-", "phap_lenh"), ("nghi-dinh-", "nghi_dinh"), ("nghi-quyet-", "nghi_quyet"),
    ("thong-tu-", "thong_tu"), ("quyet-dinh-", "quyet_dinh"), ("chi-thi-", "chi_thi"), ("luat-", "luat"), ("van-ban-hop-nhat-", "hop_nhat"),
)
#: Document number patterns in order.
DOC_NUMBERS = (
    r"(\d+/\d{4}/[\w\-Đđ]+)",
    r"(\d+/NQ\-CP)",
    r"(\d+/[\w\-]+\-CP)",
    r"(\d+/[\w\-]+\-TTg)",
    r"(\d+/[\w\-]+\-NHNN)",
    r"(\d+/[\w\-]+\-BCT)",
    r"(\d+/[\w\-]+\-BTC)",
    r"(\d+/[\w\-]+\-BGDĐT)",
    r"(\d+/[\w\-]+\-BXD)",
    r"(\d+/[\w\-]+\-BKHCN)",
    r"(\d+/[\w\-]+\-QH\d+)",
)
SIMPLE_NUMBER = r"\d+/\d{4}/[A-Z0-9-]+"
DATE = r"ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
SIGNED = r"Hà\s+Nội[,\s]+"
SIDES = r"\s+(?:và|with|vs\.?)\s+"
ABOUT = r"\s+(?:về|on|regarding)\s+"
#: Passes of the cleaner in order: pattern and what stands in its place.
NOISE = (
    (r"(?U)\s{3,}", "  "),
    (r"\n{3,}", "\n\n"),
    (r"\.{4,}", ""),
    ("[-─]{10,}", ""),
    (r"(?U)Trang\s+\d+\s*/\s*\d+", ""),
    (r"(?Umd)^\s*\d+\s*$", ""),
)
#: What headers are followed by, how an article begins, and where a clause does.
HEADERS = ((ARTICLE, r"\d+"), (CHAPTER, "[IVXLCDM]+"), (SECTION, r"\d+"))
ARTICLE_HEAD = rf"{ARTICLE}\s+\d+[a-z]?[.:]"
CLAUSE = r"\n\d+\.\s"
COMMENT = "(?s)<!--.*?-->"
NEAR_LABEL = r"(?:điểm rèn luyện|điểm trung bình chung tích lũy|điểm trung bình chung|gpa|đtb|điểm)\D{0,20}?(\d+(?:[.,]\d+)?)"
WITH_UNIT = r"(\d+(?:[.,]\d+)?)\s*(?:điểm|%)"
NUMBER = r"(\d+(?:[.,]\d+)?)"
SECRETS = ("api_key", "password", "token", "secret", "bearer ")
FORBIDDEN = ("<script", "javascript:", "data:text", "\\x00")
CITATION_WARNING = "\n\n_(Lưu ý: một số trích dẫn không khớp với nguồn được truy xuất và đã được xóa.)_"
VALUE_MISSING = "Đã xác định tiêu chí liên quan (%s) nhưng không trích xuất được số liệu cụ thể từ câu hỏi. Vui lòng nêu rõ con số (ví dụ điểm số, phần trăm)."
VERDICT_PREFIX = {"pass": "✅ **Đạt điều kiện.**", "fail": "❌ **Không đạt điều kiện.**"}
REDACTED = "[REDACTED — contains sensitive data]"
LINE_CUT = "…[cắt bớt]"
# --------------------------------------------------------------------------------------------------


def _nfc(text: Column) -> Column:
    def compose(s: pd.Series) -> pd.Series:
        odd = s.notna()
        return s.where(~odd, s[odd].map(lambda t: unicodedata.normalize("NFC", t))) if odd.any() else s

    return F.pandas_udf(compose, "string")(text)


def nfc(text: Column) -> Column:
    """Canonical composition; only the texts with combining or compatibility characters are sent to Python (it gets null for others)."""
    odd = ~text.rlike(r"^[\u0000-\u02ff\u1e00-\u1eff\u2010-\u2027\u200b\ufeff\u2500]*\z")  # one run; a search for what is not among them takes ten times as long
    return F.coalesce(_nfc(F.when(odd, text)), text)


def normalized(text: Column) -> Column:
    """NFC (built from NFC input these are the mapped dashes, quotes, blanks and deletions)."""
    return F.translate(nfc(text), *DASHES_AND_QUOTES)


def without_noise(text: Column) -> Column:
    """Six passes in their order; the second one never finds anything after the first."""
    for pattern, by in NOISE:
        text = F.regexp_replace(text, pattern, by)
    return stripped(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def with_header_breaks(text: Column) -> Column:
    """Two line breaks before articles, chapters and sections that follow anything but one."""
    for head, number in HEADERS:
        text = F.regexp_replace(text, rf"(?U)({head}(?<!\n{head})\s+{number})", "\n\n$1")  # looks behind where the word is, not everywhere
        text = F.regexp_replace(text, rf"(?U)\n{{3,}}({head}\s+{number})", "\n\n$1")
    return text


def cleaned(text: Column) -> Column:
    """The whole cleaner; null and blank text give an empty string."""
    out = with_header_breaks(without_noise(normalized(text)))
    out = F.regexp_replace(F.regexp_replace(out, "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n"), "[ \t]{2,}", " ")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), stripped(out)).otherwise("")


def markdown_cleaned(text: Column, most: int = 2000) -> Column:
    lines = F.transform(F.split(F.regexp_replace(text, COMMENT, ""), "\n"), lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(LINE_CUT))).otherwise(x))
    return stripped(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def articles(text: Column) -> Column:
    """Articles of a text in order, as an array: from a header up to the next one or the end."""
    return F.regexp_extract_all(text, F.lit(rf"(?sU)({ARTICLE_HEAD}\s+.*?)(?={ARTICLE_HEAD}|\z)"), F.lit(1))


def clauses(article: Column) -> Column:
    return F.split(article, f"(?U)(?={CLAUSE})")


def clause_count(article: Column) -> Column:
    return F.regexp_count(article, F.lit("(?U)" + CLAUSE))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n+"), stripped), lambda p: p != "")


def packed(parts: Column, most: int, joint: str = "") -> Column:
    """Greedy packing: a part joins the buffer while the lengths' sum stays within most (the joint isn't counted)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))

    def add(s, p):
        fits = F.length(s["buffer"]) + F.length(p) <= most
        return F.struct(
            F.when(fits | (s["buffer"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["buffer"]))).alias("done"),
            F.when(fits & (s["buffer"] != ""), F.concat(s["buffer"], F.lit(joint), p)).otherwise(p).alias("buffer"),
        )

    return F.aggregate(parts, start, add, lambda s: F.when(s["buffer"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["buffer"]))))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct tokens; 0 where one is empty or nothing is common."""
    common = F.size(F.array_intersect(a, b))
    return F.when(common > 0, 2.0 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def document_number(title: Column) -> Column:
    found = [F.nullif(F.regexp_extract(title, "(?U)" + p, 1), F.lit("")) for p in DOC_NUMBERS]
    return F.coalesce(*(F.regexp_replace(f, r"^\.+|\.+$", "") for f in found), F.lit(""))


def simple_number(title: Column) -> Column:
    return F.regexp_extract(title, SIMPLE_NUMBER, 0)


def signing_date(text: Column) -> Column:
    """ISO date of the signing line, else of the last date; empty without any."""
    date = DATE
    at = lambda s, p: F.concat_ws("-", F.regexp_extract(s, p, 3), F.lpad(F.regexp_extract(s, p, 2), 2, "0"), F.lpad(F.regexp_extract(s, p, 1), 2, "0"))
    line = "(?U)" + SIGNED + date
    last = F.element_at(F.regexp_extract_all(text, F.lit("(?U)" + date), F.lit(0)), -1)
    return F.when(text.rlike(line), at(text, line)).when(text.rlike("(?U)" + date), at(last, "(?U)" + date)).otherwise("")


def doc_type(url: Column) -> Column:
    slug = F.element_at(F.split(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), r"\."), 1)
    out = F.lit("other")
    for prefix, kind in reversed(DOC_TYPES):
        out = F.when(slug.startswith(prefix), kind).otherwise(out)
    return out


def safe_filename(title: Column, kind: str = "words") -> Column:
    """words: letters, digits, blanks and `-`, 80 characters; plain: letters, digits, ` -_`, 80; ascii: [a-zA-Z0-9_-], 60."""
    pattern, most = {"words": (r"[^\p{L}\p{N}_\s\-]", 80), "plain": (r"[^\p{L}\p{N} \-_]", 80), "ascii": (r"[^a-zA-Z0-9_-]", 60)}[kind]
    return stripped(F.substring(F.regexp_replace(title, pattern, "_"), 1, most))


def injection(query: Column) -> Column:
    """struct(blocked, category, score)."""
    hit = F.lit(None).cast("string")
    for pattern, category in reversed(INJECTION):
        hit = F.when(query.rlike("(?iU)" + pattern), category).otherwise(hit)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    score = flag(query.rlike(HOMOGLYPHS)) + flag(query.rlike("(?iU)" + VERBS) & query.rlike("(?iU)" + SELF)) + 0.5 * flag(F.length(query) > 600)
    return F.struct(
        (hit.isNotNull() | (score >= 1.5)).alias("blocked"), F.coalesce(hit, F.when(score >= 1.5, "heuristic"), F.lit("")).alias("category"), F.when(hit.isNotNull(), 1.0).otherwise(score).alias("score")
    )


def citation_numbers(answer: Column) -> Column:
    """Numbers of `[N]` marks that no word touches."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"(?U)(?<!\w)\[(\d{1,2})\](?!\w)"), F.lit(1)), lambda x: x.cast("int"))


def cited_indices(answer: Column) -> Column:
    """Numbers of `[1]` and `[1, 2]` marks."""
    parts = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([\d,\s]+)\]"), F.lit(1)), lambda s: F.split(s, ",")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(parts, stripped), lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("int"))))


def invalid_citations(answer: Column, n: Column) -> Column:
    return F.when((answer != "") & (n > 0), F.array_sort(F.array_distinct(F.filter(citation_numbers(answer), lambda x: (x < 1) | (x > n))))).otherwise(F.array().cast("array<int>"))


def citations_cleaned(answer: Column, n: Column) -> Column:
    """The answer without marks beyond n, and with a note where any was taken out; a mark with a leading zero stays."""
    bad = invalid_citations(answer, n)
    out = F.aggregate(bad, answer, lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"(?U)(?<!\w)\["), x.cast("string"), F.lit(r"\](?!\w)")), F.lit("")))
    return F.when(F.size(bad) > 0, F.concat(F.regexp_replace(out, r"(?U)\s+\z", ""), F.lit(CITATION_WARNING))).otherwise(answer)


def is_refusal(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike("(?iuU)" + "|".join(REFUSALS))


def is_cited(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike("(?U)" + CITED)


def is_out_of_corpus(truth: Column) -> Column:
    return F.lower(F.coalesce(truth, F.lit(""))).startswith(OUT_OF_CORPUS)


def intent(query: Column) -> Column:
    q, out = F.lower(query), F.lit("simple_qa")
    for name, phrases in reversed(INTENTS):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | q.contains(p)
        out = F.when(hit & q.rlike(r"\d") if name == "compliance_check" else hit, name).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def compare_arguments(query: Column) -> Column:
    """struct(a, b, aspect): the sides of a comparison and what it is about; the query itself where it has no two sides."""
    sides = F.split(query, "(?iuU)" + SIDES, 2)
    right = F.split(stripped(F.element_at(sides, 2)), "(?iuU)" + ABOUT, 2)
    two = F.size(sides) == 2
    aspect = F.when(F.size(right) > 1, F.nullif(stripped(F.get(right, F.lit(1))), F.lit("")))
    return F.struct(F.when(two, stripped(sides[0])).otherwise(query).alias("a"), F.when(two, stripped(right[0])).otherwise(query).alias("b"), F.when(two, F.coalesce(aspect, query)).otherwise(query).alias("aspect"))


def reformulated(query: Column, tried: Column) -> Column:
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))
    out = F.array_join(words, " ")
    return F.when((out == "") | F.array_contains(tried, out), query).otherwise(out)


def situation_value(text: Column) -> Column:
    """The number near a label, else before a unit, else any; null without one."""
    found = [F.nullif(F.regexp_extract(text, "(?iuU)" + p, 1), F.lit("")) for p in (NEAR_LABEL, WITH_UNIT, NUMBER)]
    return F.replace(F.coalesce(*found), F.lit(","), F.lit(".")).cast("double")


def redacted(message: Column) -> Column:
    hit = F.lit(False)
    for word in SECRETS:
        hit = hit | F.lower(message).contains(word)
    return F.when(hit, REDACTED).otherwise(message)


def rejection(query: Column, session: Column) -> Column:
    """Why a request is refused, null if it isn't: too_short, too_long, forbidden, bad_session."""
    q, bad = stripped(query), F.lit(False)
    for word in FORBIDDEN:
        bad = bad | F.lower(q).contains(word)
    return F.when(q.isNull() | (F.length(q) < 3), "too_short").when(F.length(q) > 1000, "too_long").when(bad, "forbidden").when(~F.coalesce(session, F.lit("")).rlike(r"^[a-zA-Z0-9_-]{1,64}\z"), "bad_session")


def client_ip(forwarded: Column, peer: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(stripped(F.split(forwarded, ",")[0]), F.lit("")), peer), 1, 45)


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def citation_label(number: Column, title: Column, header: Column, url: Column) -> Column:
    """`number — title`, then the article's header (100 characters) and the address on lines of their own, as far as they are there."""
    line = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("\n    "), c)).otherwise("")
    title = F.coalesce(title, F.lit("Không rõ"))
    head = F.when(F.coalesce(number, F.lit("")) != "", F.concat(number, F.lit(" — "), title)).otherwise(title)
    return F.concat(head, line(F.substring(header, 1, 100)), line(url))


def judge_reply(raw: Column) -> Column:
    """struct(relevant, reason) of a judge's JSON reply; null where there is none."""
    reply = F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), "relevant boolean, reason string")
    return F.when(reply.isNotNull(), F.struct(F.coalesce(reply["relevant"], F.lit(False)).alias("relevant"), F.substring(F.coalesce(reply["reason"], F.lit("")), 1, 200).alias("reason")))


# --- stored rows ------------------------------------------------------------------------------------

#: Where the second chunker cuts.
ANY_ARTICLE = r"(?iU)(?=Điều\s+\d+[.:])"
#: Keys of a stored payload that are the store's own, besides those that begin with an underscore.
INTERNAL = ("document_id", "doc_id", "ref_doc_id")


def short_timestamp(stamp: Column) -> Column:
    """dd/MM HH:mm:ss of an ISO timestamp's text; the first 19 characters where it has another form."""
    return F.regexp_replace(F.substring(stamp, 1, 19), r"(?s)^([^T-]*)-([^T-]*)-([^T-]*)T([^T]*)\z", "$3/$2 $4")


def shown_lines(text: Column, width: int = 90) -> Column:
    """An answer's lines as the history shows them: blank ones left out, each filled with its words up to width; a word that is longer goes in pieces of width."""
    pieces = lambda w: F.filter(F.split(F.regexp_replace(w, f"(?s)(.{{{width}}})", "$1\n"), "\n"), lambda x: x != "")

    def filled(line: Column) -> Column:
        words = F.flatten(F.transform(F.filter(F.split(line, "(?U)\\s+"), lambda w: w != ""), pieces))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
        fits = lambda a, w: F.length(a["line"]) + 1 + F.length(w) <= width
        put = lambda a, w: F.when(a["line"] == "", F.struct(a["done"].alias("done"), w.alias("line"))).when(fits(a, w), F.struct(a["done"].alias("done"), F.concat(a["line"], F.lit(" "), w).alias("line"))).otherwise(F.struct(F.array_append(a["done"], a["line"]).alias("done"), w.alias("line")))
        return F.aggregate(words, start, put, lambda a: F.array_append(a["done"], a["line"]))

    lines = F.filter(F.split(text, r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"), lambda x: x.rlike(r"(?U)\S"))
    return F.flatten(F.transform(lines, filled))


def public_metadata(metadata: Column, internal=()) -> Column:
    """A map without keys that begin with an underscore and those in internal; null counts as empty."""
    kept = F.map_filter(metadata, lambda k, v: ~k.startswith("_") & ~k.isin(*internal))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def payload_text(payload: Column) -> Column:
    """The text in a payload's node, which is JSON; empty where it has none or is not JSON."""
    return F.coalesce(F.from_json(payload["_node_content"], "text string")["text"], F.lit(""))


def score_scales(cosine: Column) -> dict[str, Column]:
    """The scales of the two stores and of the ablation, from a cosine: distance is 1 - cosine."""
    distance = 1 - cosine
    return {"similarity": cosine, "inverse_distance": 1 / (1 + distance), "one_less_distance": 1 - distance}
