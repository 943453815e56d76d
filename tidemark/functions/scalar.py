"""Column functions for text, URLs, casts that never fail, user agents and traffic media. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONDON = "Europe/London"

# Patterns that decide results, as plain regular expressions.
BOT_PATTERN = (
    "(?i)(bot|http|python|scan|check|spider|curl|trend|ruby|bash|batch|verification|qwantify|nuclei|ai|crawler|perl|java|test|scoop|fetch|adreview|cortex|nessus|bitdiscovery|postplanner|faraday|restsharp|hootsuite|mattermost|shortlink|retriever|auto|scrper|alyzer|dispatch|traackr|fiddler|crowsnest|gigablast|wakelet|installatron|intently|openurl|anthill|curb|trello|inject|ahc|sleep|sysdate|=|cloudinary|statuscake|cloudfront|archive|sleuth|bingpreview|facebookexternalhit|newspaper|econtext|postmanruntime|probe)"
)
SOCIAL_PATTERN = "(?i)(facebook|twitter|^t.co|linkedin|youtube|pinterest|quora|wechat|weibo|whatsapp|tumblr|reddit|x.com|instagram|tiktok|messenger|telegram|douyin|qq|qzone|josh|teams|skype|tieba|threads|viber|imo|xiaohongshu|line|picsart|bluesky)"
SEARCH_PATTERN = "(?i)(google|bing|yahoo|aol|ask.co|baidu|duckduckgo|dogpile|ecosia|entireweb|exalead|gigablast|hotbot|info.com|lycos|metacrawler|mojeek|qwant|searx|startpage|swisscows|webcrawler|yandex|yippy)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_or_null(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match's group; NULL where nothing matches (regexp_extract gives '')."""
    text = col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def safe_bool(text: Column | str) -> Column:
    """Only true and false, in any case; plain casts also take t, yes and 1."""
    low = F.lower(col(text))
    return F.when(low == "true", True).when(low == "false", False)


def safe_int(text: Column | str) -> Column:
    text = col(text)
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))


def safe_float(text: Column | str) -> Column:
    """Decimal, exponent, inf and nan forms; no type suffixes."""
    text = col(text)
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"), text.try_cast("double"))


def string_to_timestamp(text: Column | str) -> Column:
    """ISO with an offset, '1 May 2024 10:30' or '1 May 2024 3:30pm' (London time); quotes around are dropped.

    Text without a time, or in another form, is NULL.
    """
    bare = F.btrim(col(text), F.lit('"'))
    iso = F.when(bare.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?([+-]\d\d:?\d\d|Z)$"), bare.try_cast("timestamp"))
    upper = F.regexp_replace(F.regexp_replace(bare, "(?i)am$", "AM"), "(?i)pm$", "PM")
    clock = F.when(bare.rlike(r"^\d{1,2} \w+ \d{4} \d{1,2}:\d\d$"), F.try_to_timestamp(bare, F.lit("d MMMM yyyy H:mm")))
    half = F.when(bare.rlike(r"(?i)^\d{1,2} \w+ \d{4} \d{1,2}:\d\d[ap]m$"), F.try_to_timestamp(upper, F.lit("d MMMM yyyy h:mma")))
    return F.coalesce(iso, F.to_utc_timestamp(clock, LONDON), F.to_utc_timestamp(half, LONDON))


def string_to_date(text: Column | str) -> Column:
    """'2024-05-01', '1 May 2024', or the UTC date of a timestamp."""
    text = col(text)
    plain = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(text, "yyyy-MM-dd"))
    words = F.when(text.rlike(r"^\d{1,2} \w+ \d{4}$"), F.try_to_date(text, "d MMMM yyyy"))
    return F.coalesce(plain, words, F.to_date(string_to_timestamp(text)))


def string_to_int_array(text: Column | str) -> Column:
    """'[3,75,2]' as integers in order; parts that are no integers are left out, NULL is an empty array."""
    parts = F.split(F.btrim(F.coalesce(col(text), F.lit("")), F.lit("[]")), ",")
    return F.filter(F.transform(parts, lambda x: safe_int(x)), lambda x: x.isNotNull())


def decode_uri(url: Column | str) -> Column:
    """Percent-encoded runs decoded as UTF-8 (bad bytes become U+FFFD); stray percent signs go, '+' stays."""
    parts = F.regexp_extract_all(col(url), F.lit(r"(?:%[0-9A-Fa-f]{2})+|[^%]+"), F.lit(0))
    run = r"^(?:%[0-9A-Fa-f]{2})+$"
    plain = F.transform(parts, lambda p: F.when(p.rlike(run), F.make_valid_utf8(F.unhex(F.replace(p, F.lit("%"), F.lit(""))).cast("string"))).otherwise(p))
    return F.array_join(plain, "")


def standardise_path_query(url: Column | str) -> Column:
    """Path, and if there is a query its distinct pairs in order; what follows a second '?' is dropped."""
    parts = F.split(col(url), r"\?")
    pairs = F.array_join(F.array_sort(F.array_distinct(F.split(F.get(parts, F.lit(1)), "&"))), "&")
    return F.when(F.size(parts) > 1, F.concat(F.get(parts, F.lit(0)), F.lit("?"), pairs)).otherwise(F.get(parts, F.lit(0)))


def url_domain(url: Column | str) -> Column:
    return extract_or_null(url, "https?://([^/]+)")


def url_path_and_query(url: Column | str) -> Column:
    return extract_or_null(url, "https?://[^/]+(/.*)")


#: (name, pattern): the first that matches names the browser; its version follows the name in the agent.
_BROWSERS = (
    ("Yandex Browser", r"YaBrowser/([\d.]+)"), ("UC Browser", r"UCBrowser/([\d.]+)"), ("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"(?:OPR|Opera)[/ ]([\d.]+)"), ("Vivaldi", r"Vivaldi/([\d.]+)"), ("SamsungBrowser", r"SamsungBrowser/([\d.]+)"),
    ("Firefox", r"(?:Firefox|FxiOS)/([\d.]+)"), ("Chrome", r"(?:Chrome|CriOS|CrMo)/([\d.]+)"), ("Internet Explorer", r"(?:MSIE |Trident/.*rv:)([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari/"),
    ("curl", r"^curl/([\d.]+)"), ("HTTP Library", r"^(?:Wget|Python-urllib|python-requests|Apache-HttpClient|okhttp|Java|Ruby|Go-http-client|libwww-perl|PHP)/?([\d.]*)"),
)
#: (operating system, category, vendor, pattern with the version).
_SYSTEMS = (
    ("iPhone", "smartphone", "Apple", r"iPhone.*?OS ([\d_]+)"), ("iPad", "smartphone", "Apple", r"iPad.*?OS ([\d_]+)"), ("iPod", "smartphone", "Apple", r"iPod.*?OS ([\d_]+)"),
    ("Windows Phone OS", "smartphone", "Microsoft", r"Windows Phone(?: OS)? ([\d.]+)"), ("Android", "smartphone", "Google", r"Android ([\d.]+)"), ("ChromeOS", "pc", "Google", r"CrOS \w+ ([\d.]+)"),
    ("Xbox", "appliance", "Microsoft", r"(Xbox)"), ("Windows", "pc", "Microsoft", r"Windows NT ([\d.]+)"), ("Mac OSX", "pc", "Apple", r"Mac OS X ([\d_.]+)"), ("Linux", "pc", "unknown", r"(Linux)"),
    ("PlayStation", "appliance", "Sony", r"(?:PLAYSTATION|PlayStation) (?:Vita |\d[; ]+)?([\d.]+)"), ("Nintendo", "appliance", "Nintendo", r"Nintendo (?:3DS|DSi|Wii|Switch)()"),
    ("BlackBerry", "smartphone", "BlackBerry", r"(?:BlackBerry\d*|BB10).*?(?:Version)?/([\d.]+)"), ("FirefoxOS", "smartphone", "Mozilla", r"^Mozilla/[\d.]+ \((?:Mobile|Tablet);(?: rv:[\d.]+)?\) (Gecko)"),
    ("docomo", "mobilephone", "docomo", r"^(DoCoMo)/"), ("au", "mobilephone", "KDDI", r"^(KDDI)-"), ("SoftBank", "mobilephone", "SoftBank", r"^(SoftBank|Vodafone|J-PHONE)/"),
)


def parse_user_agent(agent: Column | str) -> Column:
    """struct(category, name, version, os, vendor, os_version) by ordered rules; 'unknown' where none applies.

    Category is smartphone, mobilephone, pc, appliance, crawler, misc (libraries) or unknown. A NULL agent is unknown
    throughout.
    """
    agent = F.coalesce(col(agent), F.lit(""))

    def known(*values: Column | str) -> Column:
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, ("a", "b", "c", "d"), strict=False)])

    browser, system = known("unknown", "unknown"), known("unknown", "unknown", "unknown", "unknown")
    for label, pattern in reversed(_BROWSERS):  # one test a rule, and one extraction for the rule that holds
        browser = F.when(agent.rlike(pattern), known(label, F.regexp_extract(agent, pattern, 1))).otherwise(browser)
    for label, kind, maker, pattern in reversed(_SYSTEMS):
        found = F.replace(F.regexp_extract(agent, pattern, 1), F.lit("_"), F.lit("."))
        system = F.when(agent.rlike(pattern), known(kind, label, maker, F.when(found.rlike("^[\\d.]+$"), found).otherwise("unknown"))).otherwise(system)
    crawls = agent.rlike("(?i)(googlebot|bingbot|yandexbot|baiduspider|duckduckbot|slurp|crawler|spider)")
    both = F.transform(F.array(F.struct(browser.alias("x"), system.alias("y"), crawls.alias("z"))), lambda r: F.struct(
        F.when(r["z"], "crawler").when((r["x"]["a"] == "HTTP Library") & (r["y"]["a"] == "unknown"), "misc").otherwise(r["y"]["a"]).alias("category"), r["x"]["a"].alias("name"), r["x"]["b"].alias("version"), r["y"]["b"].alias("os"), r["y"]["c"].alias("vendor"), r["y"]["d"].alias("os_version"),
    ))
    return F.get(both, F.lit(0))


def device_category(agent: Column | str, kind: Column | None = None) -> Column:
    """bot by pattern first, then by what the agent says of itself (``kind``, its category, if that is known already)."""
    kind = parse_user_agent(agent)["category"] if kind is None else kind
    known = F.when(kind == "smartphone", "mobile").when(kind == "pc", "desktop").when(kind == "crawler", "bot").otherwise("unknown")
    return F.when(col(agent).rlike(BOT_PATTERN), "bot").otherwise(known)


def traffic_medium(where: Column, domain: Column, parameters: dict[str, Column], own_site: str, social: str = SOCIAL_PATTERN, search: str = SEARCH_PATTERN, excluded: str = "(?i)(signin.education.gov.uk)") -> Column:
    """How a visit arrived: NULL from the own site; paid, e-mail, social, organic, referral; else direct or unknown.

    ``where`` is matched against the own and excluded sites, ``domain`` against social and search sites. ``parameters``
    has the attribution parameters that are collected, by name.
    """
    rules: list[tuple[Column, str | None]] = [(where.rlike(own_site), None)]
    medium = parameters.get("utm_medium")
    if medium is not None:
        rules.append((medium == "cpc", "PPC"))
    rules += [(parameters[p].isNotNull(), "PPC") for p in ("gclid", "dclid", "msclkid", "gbraid", "fbclid") if p in parameters]

    def tagged(word: str) -> list[tuple[Column, str | None]]:
        return [(medium.rlike(f"(?i)({word})"), {"email": "Email", "social": "Social", "organic": "Organic", "referral": "Referral"}[word])] if medium is not None else []

    rules += [*tagged("email"), (domain.rlike(social), "Social"), *tagged("social"), (domain.rlike(search), "Organic"), *tagged("organic")]
    rules += [(where.rlike(excluded), "Direct or unknown"), (where.isNotNull(), "Referral"), *tagged("referral")]
    out = F.lit("Direct or unknown")
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name).cast("string")).otherwise(out)
    return out
