"""Comparable forms of titles and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spellings of one character; the first of each group stands for all.
VARIANTS = """
桜樱櫻 橋桥 残殘 駆驱驅 涼凉 国國 広广廣 辺边邊邉 竜龙龍 沢泽澤 浜滨濱 円圆圓 旧舊 声聲 発发發 楽乐樂 気气氣 駅驿 画畫 鉄铁鐵 黒黑 仏佛
万萬 与與 関关關 観观觀 学學 会會 体體 伝传傳 価价價 児儿兒 内內 写写寫 処处處 剣剑劍 区區 医医醫 団团團 図图圖 売卖賣 変变變 実实實 対对對 属属屬
帰归歸 恋戀 戦战戰 払拂 拝拜 挙举舉 数數 断斷 昼晝 曽曾 条條 来來 栄荣榮 様样樣 歩步 歴历歷 毎每 涙泪淚 渋涩澀 温溫 湾灣 無无 独獨 現现 産产產
県县縣 礼禮 神神 経经經 絵绘繪 続续續 総总總 緑绿綠 縁缘緣 缶罐 聞闻 脳脑腦 芸艺藝 葉叶 薬药藥 覚觉覺 覧览覽 読读讀 説说說 賛赞贊 踊踴 転转轉
軽轻輕 進进進 遠远遠 郷乡鄉 録录錄 長长 門门 間间 雲云 静靜 顔颜顏 風风風 飛飞 髙高
"""
PAIRS = [(c, g[0]) for g in VARIANTS.split() for c in g[1:] if c != g[0]]
# Katakana that have a hiragana 0x60 below.
KANA = [(chr(c), chr(c - 0x60)) for c in [*range(0x30A1, 0x30F7), 0x30FD, 0x30FE]]
LONG_MARK = "ー"
SEARCHED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsLatin}々ー]"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(x: Column) -> Column:
    """Spark has no built-in for it; Arrow batches, for texts that are not ASCII only."""
    other = F.when(~x.rlike(r"^[\x00-\x7F]*\z"), x)
    return F.coalesce(F.pandas_udf(_nfkc, StringType())(other), x)


def _folded(x: Column) -> Column:
    kept = F.regexp_replace(F.lower(x), SEARCHED, "")
    pairs = KANA + PAIRS
    # kana first: no variant is a kana, so one pass does both
    return F.translate(kept, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def searchable(x: Column) -> Column:
    """NFKC, lower case, letters of the searched scripts only, one kana, one spelling of variants."""
    return _folded(nfkc(x))


def searchable_folded(x: Column) -> Column:
    """The same without NFKC, for text known to be in that form; stays in the JVM."""
    return _folded(x)


def loose(norm: Column) -> Column:
    return F.replace(norm, F.lit(LONG_MARK), F.lit(""))


def han_only(norm: Column) -> Column:
    return F.regexp_replace(norm, r"[^\p{IsHan}々]", "")


def searchable_text(spark, raw: str) -> str:
    """A query's form, by the same expression, on the driver's one literal."""
    return spark.range(1).select(_folded(F.lit(unicodedata.normalize("NFKC", raw)))).first()[0]


def han_only_text(spark, norm: str) -> str:
    return spark.range(1).select(han_only(F.lit(norm))).first()[0]


def trimmed(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def numeric_order(x: Column) -> Column:
    """A key that sorts runs of digits by value, whatever their length, others by Japanese rules without case and accents."""
    runs = F.regexp_extract_all(x, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda r: F.regexp_replace(r, "^0+(?=[0-9])", "")
    # a longer number is a larger one: its length comes first, in ten digits, which hold any length
    sized = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 10, "0"), bare(r))).otherwise(r))
    return F.collate(F.array_join(sized, ""), "ja_CI_AI")


def retry_after_ms(x: Column) -> Column:
    """Seconds (any decimal number; blanks are 0) or a date with its zone (against now()) as milliseconds, never negative; null if neither or empty."""
    number = F.when((trimmed(x) == ""), F.lit("0")).otherwise(F.regexp_extract(x, r"(?U)^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$", 1))
    seconds = number.try_cast("double")
    named = F.regexp_extract(x, r"^(?:[A-Za-z]{3}, )?([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1)
    iso = F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(?:Z|[+-][0-9]{2}:[0-9]{2})$"), x)
    # the zone stands in the text, so that the session's one plays no part
    date = F.coalesce(F.try_to_timestamp(F.concat(named, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")), iso.try_cast("timestamp"))
    wait = F.coalesce(F.when(seconds.isNotNull(), F.least(seconds * 1000, F.lit(9.0e18))).cast("long"), F.unix_millis(date) - F.unix_millis(F.now()))
    return F.when((x != "") & wait.isNotNull(), F.greatest(F.lit(0).cast("long"), wait))


def last_segment(url: Column) -> Column:
    """What stands behind the last slash: empty if the address ends with one, the whole without any."""
    return F.element_at(F.split(url, "/", -1), -1)


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by each value, percent-encoded as a part of an address."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.replace(F.url_encode(value.cast("string")), F.lit("+"), F.lit("%20")))
    return out


def safe_integer(x: Column) -> Column:
    """Whole numbers that a double holds exactly, as longs: decimal digits with a sign or a fraction of zeros, up to 2**53 - 1; else null."""
    said = F.regexp_extract(x, r"^([+-]?[0-9]+)(?:\.0*)?$", 1).try_cast("decimal(38,0)")
    return F.when(F.abs(said) <= F.lit(2**53 - 1), said).cast("long")


def xml_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x
