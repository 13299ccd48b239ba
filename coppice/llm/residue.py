"""Pages whose text is template residue, filler, error messages or demands for scripts instead of content.

Lines are masked (numbers, addresses, dates) and hashed. Groups of equal hashes are counted over all pages: by addresses within a
site (its furniture) and by sites (messages that many sources share). Phrase and placeholder rules then say which lines
are residue: a line that is nothing else (strict rules), or one that recurs over sites and has a telling phrase. Lines that
recur without being residue are furniture. A page is a case if it has residue and, beside furniture, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .lines import normal_text, site

# Rules on whole masked lines (lower case, digits as 0).
PLACEHOLDER = r"(?:\{\{[^{}]*\}\}|\{%[^{}]*%\}|<%=?[^<>]*%>|\$\{[^{}]*\}|%[a-z][a-z_.]*%|##+\s*[a-z_ .]+\s*##+|\[(?:insert|add|your|enter|placeholder|company|year|founder|name|title|date|image|click|type|link)\b[^\[\]]*\]|\[object object\])"
MISSING = r"(?:undefined|null|nan|none|invalid date|n/a)"
STRICT = [
    rf"(?:[a-z가-힣 ,.:;|\-–—'\"()0]{{0,40}}+{PLACEHOLDER})+[a-z가-힣 ,.:;|\-–—'\"()0]{{0,25}}",
    rf"(?:by |on |at |from )?{MISSING}(?:[ \-–,:|]+(?:on |comments?|by |views|min read)?(?:{MISSING})?)*(?: comments?| views)?",
    r"(?:lorem ipsum|dolor sit amet).*",
    r"(?:x{3,}[ .]*)+|(?:asdf|qwerty)+",
    r"(?:http|error|status)?[ :]*(?:code[: ]*)?[0 ]*(?:bad request|unauthorized|forbidden|not found|gone|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests|page not found|not_found|http 0)[.! ]*",
    r"(?:error|http|status)(?: code)?:? ?(?:0|[a-z_]+)",
    r"(?:nginx|apache|openresty|cloudflare|iis)(?:/0[.0]*)?",
    r"(?:hm|oops|sorry|uh-oh|whoops|unfortunately)?[,! ]*(?:the|this|that) (?:page|document|article|address|file|link|record|item|content|story|url)\b.*(?:not be found|no longer (?:here|available|exists?)|moved|never existed|does not exist|expired|was removed|not available|been removed|been deleted).*",
    r"(?:go )?back to (?:the )?[a-z0가-힣 \-]{1,40}|return to the (?:start|home|front|main) ?page.*",
    r".{0,60}(?:is|are) (?:currently )?down for (?:scheduled )?maintenance.*",
    r".{0,60}does not work (?:properly )?without (?:scripting|javascript|scripts).*",
    r"(?:please )?(?:you need to )?(?:enable|turn on|allow|activate) (?:javascript|scripts|scripting).*",
    r"(?:your browser|this (?:page|site|app|content)|we).{0,60}(?:javascript|scripts?|scripting)\b.*",
]
# Phrases that tell residue in a line shared by several sites, by kind.
PHRASES = [
    # scripts are required
    r"javascript|자바스크립트|scripts? (?:is|are) (?:allowed|disabled|off|required|blocked)|need scripting|scripting|loading\.\.\.",
    # errors and refusals
    r"access (?:denied|is restricted)|request blocked|request looked automated|you are (?:a )?human|not a robot|do not have permission|not authori[sz]ed|incident number|reference (?:id|number)|try again|unexpected condition|unexpected error|something went wrong|not available in your|link has expired|no results for this|try the search box|removed at the owner|start page|could not be found|no longer (?:here|available)|temporarily unavailable|internal server error|bad gateway|gateway time|forbidden|not found|database connection|maintenance|nginx|apache/0",
    r"접근 권한|관리자에게 문의|찾을 수 없|주소를 다시 확인|일시적인 오류|이용할 수 없|잠시 후 다시|오류가 발생|점검 중|만료된",
    # traces
    r"traceback|stack trace|exception|keyerror|typeerror|valueerror|syntaxerror|fatal error|warning: undefined|undefined variable|^file \".*line 0|^\s*at [a-z.]+\(|^on line 0|segmentation fault|errno",
    # fillers
    r"lorem ipsum|goes here|sample (?:item|text)|text to follow|^todo\b|write a short introduction|nothing to see here|placeholder|dummy text|^heading 0$|^status: |^http 0$|your (?:title|text|name) here|가나다라|예시 문장|입력하세요|이미지 설명|내용을 입력|샘플 텍스트",
    PLACEHOLDER,
    rf"^(?:by )?{MISSING}\b",
]
# Marks of furniture that names its site and so need not recur.
FURNITURE = r"^(?:©|\(c\))|cookies|all rights reserved|무단 전재|저작권|registered office|필수 저장 정보|store information on your device|small files in your browser|필요한 저장|subscribe below|sign up|newsletter|소식지|briefing every|^(?:[^.!?|·/•»>]{0,24}+[|·•/»>])++[^.!?|·/•»>]{1,24}$|^[*\-•] ?[^.!?]{1,24}$|^\[[^\]]{1,24}\]$|^advertisement$|^광고$"
# Frequent words of the filler text in Latin.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nunc vero augue arcu tellus mauris purus quam porta varius felis rutrum lectus justo orci donec ligula".split()


def masked_lines(text: Column) -> Column:
    """Normalised lines with addresses and dates with a month's name masked."""
    months = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}"
    dated = F.regexp_replace(normal_text(text), rf"0(?:(?<=\b0) {months}\b(?:\.? 0\b)?|(?<=\b{months}\.? 0)\b)", "<day>")
    address = r"\bhttps?://\S+|(?<!\S)[^\s@]{1,64}@[^\s@]+\.[a-z]{2,}"
    return F.transform(F.split(dated, "\n"), lambda x: F.when(F.contains(x, F.lit("@")) | F.contains(x, F.lit("://")), F.regexp_replace(x, address, "<addr>")).otherwise(x))


def _latin(line: Column) -> Column:
    ws = F.filter(F.split(line, "[^a-z]+"), lambda w: w != "")
    hits = F.size(F.filter(ws, lambda w: w.isin(LATIN)))
    return (F.size(ws) >= 4) & (hits >= 0.7 * F.size(ws))


def strict(line: Column) -> Column:
    return line.rlike("^(?:" + "|".join(STRICT) + ")$") | _latin(line)


def shaped(line: Column) -> Column:
    """Whether a line has the shape of furniture; a notice of more than 200 characters must recur to count as such."""
    return F.when(F.length(line) <= 200, line.rlike(FURNITURE)).otherwise(False)


def telling(line: Column) -> Column:
    return line.rlike("|".join(PHRASES))


def residue_pages(pages: DataFrame, *, own_urls: int = 3, sites: int = 3) -> DataFrame:
    """(page_id, n_residue): the pages without real content, each once.

    pages: page_id, final_url, text. Blank and null texts are no cases. A page without a host has no furniture of its own.
    Texts are masked once, into hashes that are counted. A page whose longest line no rule takes and that does not recur has
    content and is done with; of the others each distinct line is judged once, and the verdicts come back by hash.
    """
    rows = pages.where(F.col("text").isNotNull()).select("page_id", "final_url", "text", F.coalesce(site(F.col("final_url")), F.lit("")).alias("site"))
    masked = rows.select("page_id", F.xxhash64("final_url").alias("u"), F.xxhash64("site").alias("s"), F.inline(F.array(F.struct(masked_lines(F.col("text")).alias("a")))))
    masked = masked.select("page_id", "u", "s", F.transform("a", lambda x: F.xxhash64(x)).alias("hs"), F.inline(F.array(F.array_max(F.transform("a", lambda x: F.struct(F.length(x).alias("n"), x.alias("top")))))))
    blank = F.xxhash64(F.lit(""))
    keyed = cut(masked.where("n > 0").select("page_id", "u", "s", F.array_distinct(F.filter("hs", lambda h: h != blank)).alias("hs"), F.xxhash64("top").alias("h"), (~strict(F.col("top")) & ~shaped(F.col("top"))).alias("open")))
    per_site = keyed.select("s", "u", F.explode("hs").alias("h")).groupBy("s", "h", "u").agg(F.lit(1).alias("one")).groupBy("s", "h").agg(F.count("*").alias("n"))
    own = cut(per_site.where(F.col("n") >= own_urls).select("s", "h", F.lit(True).alias("own")))
    wide = cut(per_site.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= sites).select("h", F.lit(True).alias("wide")))

    recurrent = lambda df: df.join(own, ["s", "h"], "left").join(wide, "h", "left").na.fill(False, ["own", "wide"])
    left = recurrent(keyed.select("page_id", "s", "h", "open")).where(~F.col("open") | F.col("own") | F.col("wide")).select("page_id").distinct()
    each = rows.join(left, "page_id", "left_semi").select("page_id", F.xxhash64("site").alias("s"), F.explode(masked_lines(F.col("text"))).alias("line")).where(F.col("line") != "")
    each = cut(each.withColumn("h", F.xxhash64("line")))
    line = F.col("line")
    judged = each.groupBy("h").agg(F.first("line").alias("line")).select("h", strict(line).alias("strict"), telling(line).alias("telling"), shaped(line).alias("shape"))
    flags = recurrent(each.select("page_id", "s", "h").distinct()).join(judged, "h")
    residue = F.col("strict") | (F.col("telling") & F.col("wide"))
    content = ~residue & ~F.col("own") & ~F.col("wide") & ~F.col("shape")
    found = flags.groupBy("page_id").agg(F.sum(residue.cast("int")).alias("n_residue"), F.sum(content.cast("int")).alias("content"))
    return found.where((F.col("n_residue") > 0) & (F.col("content") == 0)).select("page_id", "n_residue")
