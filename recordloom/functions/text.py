"""Text expressions, column to column, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: function words that a headline shares with any page.
STOPWORDS = (
    "the and but for from with are was were been being this that these those its into over after before "
    "about than then has have had not will would can could may might shall should does did they you his her "
    "their our your him them who whom which what when where why how all any some more most other such only "
    "own same too very just also new says said say amid upon via"
).split()
#: Unicode blocks by script.
SCRIPTS = {
    "kannada": "\\u0C80-\\u0CFF", "tamil": "\\u0B80-\\u0BFF", "devanagari": "\\u0900-\\u097F", "telugu": "\\u0C00-\\u0C7F",
    "bengali": "\\u0980-\\u09FF", "malayalam": "\\u0D00-\\u0D7F", "gujarati": "\\u0A80-\\u0AFF", "gurmukhi": "\\u0A00-\\u0A7F",
    "odia": "\\u0B00-\\u0B7F", "arabic": "\\u0600-\\u06FF\\u0750-\\u077F\\uFB50-\\uFDFF\\uFE70-\\uFEFF",
}
#: Fixed value: consonant folds, longest first.
FOLDS = (("chh", "c"), ("ch", "c"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ph", "f"), ("sh", "s"), ("w", "v"), ("z", "j"), ("q", "k"), ("ck", "k"))
#: Fixed value: legal forms that are no part of a company's name.
LEGAL_FORMS = "ltd limited inc incorporated corp corporation co company plc llc llp pvt private".split()
#: Fixed value: words that mark an automatic visitor.
BOTS = (
    "bot|crawl|spider|slurp|headless|lighthouse|preview|curl|wget|python-|httpx|axios|node-fetch|go-http|java/|okhttp|phantomjs|puppeteer|playwright"
)
#: Fixed value: real HTML elements, so that other text in angle brackets is left alone.
TAGS = (
    "p|div|span|a|em|strong|b|i|u|br|hr|ul|ol|li|h[1-6]|img|figure|figcaption|blockquote|table|thead|tbody|tr|td|th|section|article|header|"
    "footer|nav|aside|iframe|script|style|picture|source|video|audio|small|sup|sub|pre|code"
)
#: Fixed value: where an arrival came from, by referrer domain.
REFERRERS = {
    "search": ("google.com", "google.co.in", "bing.com", "duckduckgo.com", "yahoo.com", "yandex.ru", "ecosia.org", "baidu.com", "search.brave.com"),
    "ai": ("chatgpt.com", "chat.openai.com", "perplexity.ai", "claude.ai", "gemini.google.com", "copilot.microsoft.com"),
    "social:whatsapp": ("whatsapp.com", "wa.me"), "social:x": ("t.co", "x.com", "twitter.com"),
    "social:facebook": ("facebook.com", "fb.com", "m.facebook.com", "l.facebook.com"), "social:instagram": ("instagram.com", "l.instagram.com"),
    "social:linkedin": ("linkedin.com", "lnkd.in"), "social:reddit": ("reddit.com",), "social:telegram": ("t.me", "telegram.org"),
}
#: Fixed value: query keys that only track.
TRACKING = ("_ga", "at_campaign", "at_link_id", "at_medium", "at_ptr_name", "dclid", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "msclkid")

#: Fixed value: initials and abbreviations whose stop ends no sentence.
ABBREVIATION = (
    r"(?:^|[\s(“\"'])(?:[A-Z]|Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|No|Nos|Rs|Re|vs|Lt|Col|Gen|Maj|Capt|Sgt|Hon|Rev|Fr|Smt|Shri|Md|Adv|"
    r"Justice|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Inc|Ltd|Pvt|Co|Corp|Govt|Dept|Univ|approx|est)\.$"
)


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def content_words(text: Column, least: int = 3) -> Column:
    """Distinct words of ``least`` characters or more that are neither numbers nor function words."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= least) & ~w.rlike(r"^\p{N}+$"))
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, STOPWORDS)))


def title_share(title_words: Column, flat_text: Column) -> Column:
    """Fraction of the title's content words whose stem the text holds; null under three words."""
    stem = lambda w: F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2))
    held = F.filter(title_words, lambda w: F.contains(flat_text, stem(w)))
    return F.when(F.size(title_words) >= 3, F.size(held) / F.size(title_words))


def sentences(text: Column) -> Column:
    """Sentences; a stop after an initial or an abbreviation does not end one.

    Every gap after a stop becomes a mark, gaps after abbreviations become blanks again, and
    what is left of the marks is where the text is cut.
    """
    blank = " \t\n\x0b\x0c\r"
    mark = "\x01"
    parts = F.split(F.regexp_replace(F.btrim(text, F.lit(blank)), r"([.!?][\"’”]?)\s+", f"$1{mark}"), mark)
    parts = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(blank))), lambda p: p != "")
    ended = F.transform(parts, lambda p: F.concat(p, F.when(F.regexp(p, F.lit(ABBREVIATION)), " ").otherwise(mark)))
    whole = F.regexp_replace(F.array_join(ended, ""), f"[ {mark}]$", "")
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, mark))


def flat_ws(text: Column) -> Column:
    """White space collapsed and trimmed; offsets of quotes refer to this text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """Tags become a space, then the named entities are decoded: in this order, so escaped tags stay visible."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def leaked_tags(text: Column) -> Column:
    """Number of real HTML tags; two or more mean that markup leaked."""
    return F.regexp_count(text, F.lit(rf"(?i)</?(?:{TAGS})(?:\s[^>]*)?/?>"))


def _count(text: Column, block: str) -> Column:
    """How many characters of ``text`` are in ``block``; they go run by run, and no class is negated."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{block}]+", ""))


def _high(text: Column) -> Column:
    """``text`` without what comes before the first of the listed scripts, Latin text above all."""
    return F.regexp_replace(text, r"[\x00-\u05FF]+", "")


def script_of(text: Column) -> Column:
    """The script whose block leads; Latin if none occurs; ties in the order listed."""
    high = _high(F.coalesce(text, F.lit("")))
    counts = [F.struct(_count(high, block).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, block) in enumerate(SCRIPTS.items())]
    # bound once: spelt out, it would be searched again for every use
    best = F.get(F.transform(F.array(F.array_max(F.array(*counts))), lambda b: F.when(b["n"] > 0, b["name"]).otherwise("latin")), 0)
    return F.when(high == "", "latin").otherwise(best)


def is_latin(text: Column) -> Column:
    """Latin letters outnumber those of the listed scripts."""
    return _count(text, "A-Za-z\\u00C0-\\u024F") > _count(_high(text), "".join(SCRIPTS.values()))


def is_headline_list(text: Column) -> Column:
    """Twelve lines of three words or more, their median 6 to 16 words, at most a tenth ending a sentence."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.size(F.split(x, r"\s+")) >= 3)
    counts = F.array_sort(F.transform(lines, lambda x: F.size(F.split(x, r"\s+"))))
    n = F.size(lines)
    middle = (F.get(counts, ((n - 1) / 2).cast("int")) + F.get(counts, (n / 2).cast("int"))) / 2
    ended = F.size(F.filter(lines, lambda x: x.rlike("[.।॥:;\"”’)]$")))
    return F.coalesce((n >= 12) & middle.between(6, 16) & (ended <= 0.1 * n), F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of all words, each padded with two leading and one trailing space."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def canonical_name(name: Column) -> Column:
    """Punctuation variants of a name folded: trailing own acronym, dots, apostrophes, spaced initials."""
    s = F.trim(name)
    head, paren = F.regexp_extract(s, r"^(.*?)\s*\(([A-Za-z]{2,})\)\s*$", 1), F.regexp_extract(s, r"^(.*?)\s*\(([A-Za-z]{2,})\)\s*$", 2)
    initials = F.array_join(F.transform(F.regexp_extract_all(head, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.substring(w, 1, 1)), "")
    s = F.when((paren != "") & (F.lower(initials) == F.lower(paren)), F.trim(head)).otherwise(s)
    s = F.regexp_replace(s, "[.'’]", "")
    s = F.regexp_replace(s, r"\b([A-Za-z])\s+(?=[A-Za-z]\b)", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def skeleton(slug: Column) -> Column:
    """Consonant skeleton, word by word."""
    s = F.replace(slug, F.lit("-"), F.lit(" "))
    for a, b in FOLDS:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"([a-z])\1+", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[aeiouy]", ""), " +", " "))


def name_keys(slug: Column) -> Column:
    """Keys two spellings of one name share: the respaced slug, and the skeleton where it is long enough."""
    sk = skeleton(slug)
    safe = F.contains(sk, F.lit(" ")) & (F.length(F.replace(sk, F.lit(" "), F.lit(""))) >= 5)
    return F.array_compact(F.array(F.concat(F.lit("r:"), F.replace(slug, F.lit("-"), F.lit(""))), F.when(safe, F.concat(F.lit("s:"), sk))))


def company_key(name: Column) -> Column:
    """A company's name without punctuation and legal forms."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(LEGAL_FORMS)), " ")


def display_name(snake: Column, acronyms: tuple[str, ...] = ("gdp", "rbi", "ipo", "promo")) -> Column:
    """snake_case as words, acronyms in capitals, the first word capitalised."""
    tokens = F.transform(F.split(F.lower(snake), "_"), lambda t, i: F.when(t.isin(*acronyms), F.upper(t)).when(i == 0, F.initcap(t)).otherwise(t))
    return F.array_join(tokens, " ")


def numbers(text: Column) -> Column:
    """Distinct numbers printed in a text, thousands marks and final stops removed."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9.,]*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.rtrim(n, F.lit(".,"))))


def grounded(line: Column, rows: Column) -> Column:
    """Every number of the line occurs in the rows."""
    return F.size(F.array_except(numbers(line), numbers(rows))) == 0


def is_bot(agent: Column) -> Column:
    return (F.coalesce(agent, F.lit("")) == "") | agent.rlike(f"(?i){BOTS}")


def referrer_source(host: Column) -> Column:
    """Search, AI, social or other, by dotted domain suffix; an empty host is direct."""
    h = F.lower(F.trim(F.coalesce(host, F.lit("")), F.lit(".")))
    out = F.when(h == "", "direct").when(~h.rlike("^[a-z0-9.-]{1,253}$"), "other")
    for name, domains in REFERRERS.items():
        hit = F.lit(False)
        for d in domains:
            hit = hit | (h == d) | h.endswith("." + d)
        out = out.when(hit, name)
    return out.otherwise("other")


def story_slug(title: Column, key: Column) -> Column:
    """A readable prefix of at most 48 ASCII characters and six hex digits of the key."""
    ascii_ = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.rtrim(F.substring(ascii_, 1, 48), F.lit("-")), F.lit("-"), F.substring(F.md5(key), 1, 6))


def canonical_url(url: Column) -> Column:
    """A comparison key: https, lower-case host without default port, no fragment, no tracking keys, sorted query.

    Built-in expressions only; hosts beyond ASCII and escapes in queries are left as they are
    (``functions.unicode.canonicalise_url`` has the whole rule).
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    usual = raw.rlike(r"(?i)^https?://[^/?#@]+([/?#]|$)")
    rest = F.regexp_replace(F.regexp_replace(raw, "(?i)^https?://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "(:80|:443)$", ""), r"\.$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~_tracks(F.substring_index(p, "=", 1)))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    sorted_ = F.array_join(F.array_sort(pairs), "&")
    out = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(sorted_ != "", F.concat(F.lit("?"), sorted_)).otherwise(F.lit("")))
    return F.when(raw == "", None).when(usual, out).otherwise(raw)


def _tracks(key: Column) -> Column:
    k = F.lower(key)
    return k.startswith("utm_") | k.isin(*TRACKING)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, on 32-bit halves so that nothing overflows."""
    half = lambda x, at: F.conv(F.substring(x, at, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def dhash(pixels: Column) -> Column:
    """64-bit difference hash, as hex, of a 9x8 grey image given row by row in 72 integers."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(pixels, i + (i / 8).cast("int")) > F.get(pixels, i + (i / 8).cast("int") + 1), "1").otherwise("0"))
    return F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))
