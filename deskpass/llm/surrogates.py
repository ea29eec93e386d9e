"""PII surrogates (DataFrame functions only).

Detected entities are replaced by keyed surrogates of the same type: a hash of key,
type, value and attempt picks every character from the alphabet of the replaced one
(digit, case, accent, script), names come from the same gender and script, a card's check
digit stays valid (an IBAN's two do not), country codes, separators and prefixes stay. A mention is cut into
parts (address into local part and domain, name into given name and surname), and each
different part of a type gets one surrogate for the whole corpus, so mentions that
referred to one thing still do. Surrogates are checked: none may equal another's or a
real value of its type; those that do are drawn again, longer after a few attempts.

Only entities are grouped and joined. Texts without any are never shuffled; texts with
some meet their surrogates under the hash of the text. Copies of one text and mentions
of one value cost one row after map-side distinct; joins are split by AQE when a value
or a text holds a large share.

Defined cases: null text stays null; texts without entities stay as they are; ids play
no part, so null or repeated ids and repeated rows keep their rows; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpass.llm.common import col, free_name, need, stage

LONGER_AFTER = 3   # attempts after which a surrogate may grow by a character each
KEY = "surrogate-key"

# Forms of address by gender, as written before or after a name.
TITLES_M = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Господин", "Г-н"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Г-жа"]
TITLES_N = ["Dr", "Prof"]
AFTER_M, AFTER_F, AFTER_N = ["先生"], ["女士", "小姐"], [" 씨"]
# Given names by script and gender (n: any), and syllables of made-up names.
GIVEN = {
    "latin_m": ["Adam", "Ben", "Carl", "David", "Emil", "Felix", "George", "Hugo", "Ivan", "Jonas", "Leon", "Martin"],
    "latin_f": ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria"],
    "latin_n": ["Alex", "Chris", "Dominique", "Jamie", "Kim", "Kit", "Lee", "Robin", "Sam", "Sascha", "Toni", "Vali"],
    "cyrillic_m": ["Алексей", "Борис", "Виктор", "Григорий", "Дмитрий", "Иван", "Михаил", "Олег", "Павел", "Сергей"],
    "cyrillic_f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "Татьяна", "Юлия"],
    "cyrillic_n": ["Валя", "Женя", "Паша", "Саша", "Слава", "Шура"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fo", "gar", "hin", "kel", "lo", "mar", "nes", "pol", "ras", "sen", "tor", "vik", "wen", "zan"],
    "cyrillic": ["ба", "вел", "го", "дар", "жин", "кел", "ло", "мар", "нес", "пол", "рас", "сен", "тор", "фед", "хан", "чер"],
    "han": ["安", "白", "成", "东", "方", "高", "海", "江", "林", "明", "宁", "平", "文", "新", "远", "志"],
    "hangul": ["강", "구", "나", "도", "라", "무", "보", "서", "안", "영", "준", "지", "태", "하", "현", "희"],
}
# Alphabets that a character is replaced within.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñòóôöùúûüß",
             "ÀÁÂÄÇÈÉÊËÍÎÏÑÒÓÔÖÙÚÛÜ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]


def _before(titles: list[str]) -> str:
    return "(?:" + "|".join(sorted(titles, key=len, reverse=True)) + r")\.?\s"


_NAME = r"\p{Lu}[\p{Ll}\p{M}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@"
         r"(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}")
SECRET_HEAD = r"(?i:\b(?:token|api[_-]?key|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?)"
SECRET = SECRET_HEAD + r"[A-Za-z0-9_+/=-]{8,}"
IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.[0-9])"
_IP6 = "[0-9A-Fa-f]{1,4}"
# whole, or with :: in place of groups (at least two groups and a colon more, so not a time or "a::b")
IP6 = (rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_IP6}:){{7}}{_IP6}|(?=[0-9A-Fa-f]*[0-9][0-9A-Fa-f:]*(?![\p{{L}}\p{{N}}]))(?:{_IP6}:){{1,6}}(?::{_IP6}){{1,6}})"
       r"(?![\p{L}\p{N}:])")
# Lengths of IBANs by country.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
                26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
                30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
IBAN = (r"(?<![\p{L}\p{N}])(?:" + "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ \u00a0-]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![\p{L}\p{N}])")
CARD = (r"(?<![\p{L}\p{N}])(?:[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4}(?:[ -][0-9]{3})?|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}"
        r"|3(?:0[0-5]|[689][0-9])[0-9][ -]?[0-9]{6}[ -]?[0-9]{4})(?![\p{L}\p{N}])")
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
PHONE = (r"(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])"
         r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}(?![\p{L}\p{N}])"
         r"|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}-])"
         # national: by groups of three, three and four, by pairs after 0, or 0 and an area code (8 to 12 digits)
         r"|(?<![\p{L}\p{N}.,-]|[0-9] )(?:[2-9][0-9]{2} [0-9]{3} [0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}"
         r"|(?=0[0-9](?:[ /-]?[0-9]){6,10}(?![0-9]))0[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,3})(?![\p{L}\p{N}-]|[ .,][0-9])")
PERSON = (r"(?<![\p{L}\p{N}])" + _before(TITLES_M + TITLES_F + TITLES_N) + _NAME + r"(?:\s" + _NAME + r")?"
          + r"|\p{IsHan}{2,3}(?:" + "|".join(AFTER_M + AFTER_F) + r")|(?<!\p{IsHangul})\p{IsHangul}{2,4}" + AFTER_N[0] + r"(?!\p{IsHangul})")
ANY = "|".join([EMAIL, SECRET, IP, IP6, IBAN, CARD, SSN, PHONE, PERSON])
# What every entity holds, cheap to look for: most places of a text fail at the first class.
_TITLES = TITLES_M + TITLES_F + TITLES_N
_SIGNS = "0-9@=:先女小씨"
HINT = rf"(?=[{_SIGNS}{''.join(sorted({t[0] for t in _TITLES}))}])(?:[{_SIGNS}]|(?:" + "|".join(_TITLES) + r")\.?\s)"


def found(text: Column) -> Column:
    """All mentions of a text in order (an empty array for none or null)."""
    return F.when(text.rlike(HINT), F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array())).otherwise(
        F.array().cast("array<string>"))


def _parts(m: Column) -> Column:
    """array<struct(type, head, value, tail)> of a mention: head and tail stay, value is replaced."""
    part = lambda kind, value, head="", tail="": F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (F.lit(head) if isinstance(head, str) else head).alias("head"),
        value.alias("value"), (F.lit(tail) if isinstance(tail, str) else tail).alias("tail"))
    full = lambda p: m.rlike("^(?:" + p + ")$")
    after = "(" + "|".join(AFTER_M + AFTER_F + AFTER_N) + ")$"
    title = F.regexp_extract(m, "^(" + _before(TITLES_M + TITLES_F + TITLES_N) + ")", 1)
    gender = (F.when(m.rlike("^" + _before(TITLES_M)), "m").when(m.rlike("^" + _before(TITLES_F)), "f").otherwise("n"))
    rest = F.substring(m, F.length(title) + 1, F.length(m))
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    space = F.regexp_extract(rest, r"(\s)", 1)
    given = F.regexp_extract(rest, r"^(\S+)", 1)
    family = F.regexp_extract(rest, r"\s(\S+)$", 1)
    secret = F.regexp_extract(m, "^(" + SECRET_HEAD + ")", 1)
    ending = F.regexp_extract(m, after, 1)
    short = F.regexp_replace(m, after, "")
    return (F.when(full(SECRET), F.array(part("secret", F.substring(m, F.length(secret) + 1, F.length(m)), secret)))
            .when(m.contains("@"), F.array(part("mailbox", F.substring_index(m, "@", 1), tail="@"),
                                           part("domain", F.substring_index(m, "@", -1))))
            .when(full(IP), F.array(part("ip", m)))
            .when(full(IP6), F.array(part("ip6", m)))
            .when(full(IBAN), F.array(part("iban", m)))
            .when(full(CARD), F.array(part("card", m)))
            .when(full(SSN), F.array(part("ssn", m)))
            .when(title != "", F.when(space != "", F.array(
                part(F.concat(F.lit("given_"), script, F.lit("_"), gender), given, title, space),
                part(F.concat(F.lit("family_"), script), family))).otherwise(
                    F.array(part(F.concat(F.lit("family_"), script), rest, title))))
            .when(ending != "", F.array(part(F.when(short.rlike(r"\p{IsHangul}"), "family_hangul").otherwise("family_han"), short, tail=ending)))
            .otherwise(F.array(part("phone", m))))


def _norm(kind: Column, value: Column) -> Column:
    """The value under which mentions corefer: digits of numbers, lower case of addresses."""
    return (F.when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(value, "[^0-9A-Za-z]", ""))
            .when(kind.isin("mailbox", "domain", "ip6"), F.lower(value)).otherwise(value))


def _number(h: Column, i: Column | int, below: int) -> Column:
    """The i-th pseudo-random number of a hash (128 hex digits, four each, used again after 32)."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32 * 4 + 1
    return F.conv(F.substring(h, at.cast("int"), F.lit(4)), 16, 10).cast("int") % below


def _draw(h: Column, i: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _number(h, i, len(alphabet)) + 1, F.lit(1))


def _respell(value: Column, h: Column, keep: Column, hexadecimal: Column) -> Column:
    """Every character past the first ``keep`` from its own alphabet; others (separators) as they are."""
    def one(c: Column, i: Column) -> Column:
        out = F.when(i < keep, c)
        for a in HEX:
            out = out.when(hexadecimal & F.lit(a).contains(c), _draw(h, i, a))
        for a in ALPHABETS:
            out = out.when(F.lit(a).contains(c), _draw(h, i, a))
        return out.otherwise(c)
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), one), "")


def _luhn(body: Column) -> Column:
    """Check digit of a number without it."""
    digits = F.transform(F.regexp_extract_all(F.reverse(body), F.lit("."), F.lit(0)), lambda c, i: F.when(
        i % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)))
    return ((10 - F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, x: a + x) % 10) % 10).cast("int").cast("string")


def _candidate(kind: Column, norm: Column, attempt: int, key: str) -> Column:
    seed = F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt)))
    h = F.sha2(seed, 512)
    no = F.lit(False)
    domain_keep, tld = F.lit(0), F.substring_index(norm, ".", -1)
    longer = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(1, attempt - LONGER_AFTER + 1))),
                                      lambda i: _draw(h, i + 17, ALPHABETS[1])), "") if attempt >= LONGER_AFTER else F.lit("")
    digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(1, attempt - LONGER_AFTER + 1))),
                                      lambda i: _draw(h, i + 17, ALPHABETS[0])), "") if attempt >= LONGER_AFTER else F.lit("")
    hexa = norm.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & norm.rlike("[a-fA-F]")
    spelled = F.concat(_respell(norm, h, F.lit(0), no), longer)
    body = F.substring(norm, F.lit(1), F.length(norm) - 1)
    new_body = _respell(body, h, F.lit(1), no)
    card = F.concat(new_body, F.when(_luhn(body) == F.substring(norm, -1, 1), _luhn(new_body))
                    .otherwise(_draw(h, F.lit(31), ALPHABETS[0])))
    octet = lambda i: (_number(h, i, 254) + 1).cast("string")
    private = norm.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    ip = F.concat_ws(".", F.when(private, F.lit("10")).otherwise((_number(h, 0, 100) + 11).cast("string")), octet(1), octet(2), octet(3))
    host = F.substring(norm, F.lit(1), F.length(norm) - F.length(tld) - 1)
    out = (F.when(kind == "secret", F.concat(_respell(norm, h, F.lit(0), hexa), longer))
           .when(kind == "mailbox", spelled)
           .when(kind == "domain", F.concat(_respell(host, h, domain_keep, no), longer, F.lit("."), tld))
           .when(kind == "ip", ip)
           .when(kind == "ip6", F.concat_ws(":", F.concat(F.lit("fd"), F.substring(h, 1, 2)), *[F.substring(h, 4 * k + 1, 4) for k in range(1, 8)]))
           .when(kind == "card", F.concat(card, digits))
           .when(kind == "iban", F.concat(_respell(norm, h, F.lit(2), no), digits))
           .when(kind == "ssn", F.concat(_respell(norm, h, F.lit(0), no), digits))
           .when(kind == "phone", F.concat(_respell(norm, h, F.when((F.length(norm) == 11) & norm.startswith("1"), 1)
                                                    .when(F.length(norm) > 10, 2).otherwise(0), no), digits)))
    for script, syllables in SYLLABLES.items():
        n = (2 if script in ("han", "hangul") else 3) + max(0, attempt - 1)
        made = F.concat(*[F.element_at(F.array(*map(F.lit, syllables)), _number(h, 3 + i, len(syllables)) + 1) for i in range(n)])
        if script in ("latin", "cyrillic"):
            made = F.initcap(made)
        out = out.when(kind == f"family_{script}", made)
        for gender in "mfn":
            names = GIVEN.get(f"{script}_{gender}")
            if names:
                pick = F.element_at(F.array(*map(F.lit, names)), _number(h, 1, len(names)) + 1)
                more = F.element_at(F.array(*map(F.lit, names)), _number(h, 2, len(names)) + 1)
                tail = F.array_join(F.array(*[F.element_at(F.array(*map(F.lit, names)), _number(h, 4 + i, len(names)) + 1)
                                              for i in range(max(0, attempt - 1))]), "-")
                name = pick if attempt == 0 else F.concat_ws("-", pick, more) if attempt == 1 else F.concat_ws("-", pick, more, tail)
                out = out.when(kind == f"given_{script}_{gender}", name)
    return out


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, norm, surrogate) of distinct (type, norm), no surrogate equal to another or to a real value of its type."""
    pending = stage(entities.select("type", "norm").distinct(), "pii-entities")
    real = pending.select(F.col("type").alias("r_type"), F.lower("norm").alias("r_norm")).distinct()
    done = None
    attempt = 0
    while True:
        # one chooser per surrogate: the smallest value; the others draw again
        drawn = pending.select("type", "norm", _candidate(F.col("type"), F.col("norm"), attempt, key).alias("surrogate"))
        drawn = drawn.withColumn("low", F.lower("surrogate"))
        taken = real if done is None else real.unionByName(
            done.select(F.col("type").alias("r_type"), F.lower("surrogate").alias("r_norm")))
        first = drawn.groupBy("type", "low").agg(F.min("norm").alias("winner"))
        first = first.join(taken, (F.col("type") == F.col("r_type")) & (F.col("low") == F.col("r_norm")), "left_anti")
        won = stage(drawn.join(first.select(F.col("type").alias("w_type"), F.col("low").alias("w_low"), "winner"),
                               (F.col("type") == F.col("w_type")) & (F.col("low") == F.col("w_low")) & (F.col("norm") == F.col("winner")))
                    .select("type", "norm", "surrogate"), "pii-surrogates")
        done = won if done is None else done.unionByName(won)
        w = won.select(F.col("type").alias("w_type"), F.col("norm").alias("w_norm"))
        pending = stage(pending.join(w, (F.col("type") == F.col("w_type")) & (F.col("norm") == F.col("w_norm")), "left_anti"), "pii-pending")
        if not pending.limit(1).count():
            return done
        attempt += 1


def _render(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: separators of numbers, capitals of addresses."""
    def one(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(surrogate, nth, F.lit(1))).otherwise(c)
    plain = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    spaced = F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), one), "")
    rest = F.substring(surrogate, F.length(plain) + 1, F.length(surrogate))
    return (F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(spaced, rest))
            .when(kind.isin("mailbox", "domain") & (value == F.upper(value)) & value.rlike(r"\p{Lu}"), F.upper(surrogate))
            .otherwise(surrogate))


def replace_pii(docs: DataFrame, text: str = "text", key: str = KEY, count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count_col`` names a further column for the number of mentions."""
    need(docs, text)
    names = docs.columns
    t = col(text).cast("string")
    has = F.coalesce(F.size(found(t)) > 0, F.lit(False))
    texts = docs.where(t.isNotNull()).select(F.md5(t).alias("h"), found(t).alias("m")).where(F.size("m") > 0).distinct()
    mentions = texts.select("h", F.posexplode("m").alias("pos", "mention"))
    parts = mentions.select("h", "pos", F.posexplode(_parts(F.col("mention"))).alias("part", "x"))
    parts = stage(parts.select("h", "pos", "part", "x.*").withColumn("norm", _norm(F.col("type"), F.col("value"))), "pii-parts")
    chosen = stage(assign(parts, key), "pii-chosen").select(
        F.col("type").alias("c_type"), F.col("norm").alias("c_norm"), "surrogate")
    j = parts.join(chosen, (F.col("type") == F.col("c_type")) & (F.col("norm") == F.col("c_norm")))
    piece = F.concat("head", _render(F.col("type"), F.col("value"), F.col("surrogate")), "tail")
    mention = (j.select("h", "pos", "part", piece.alias("piece")).groupBy("h", "pos")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("new")))
    lists = stage(mention.groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))),
                                                       lambda x: x["new"]).alias("news")), "pii-lists")
    hk = free_name(docs, "text_md5")
    some = docs.where(has).withColumn(hk, F.md5(t))
    lk, news = free_name(docs, "list_md5"), free_name(docs, "news")
    some = some.join(lists.select(F.col("h").alias(lk), F.col("news").alias(news)), col(hk) == col(lk))
    gaps = F.split(t, ANY, -1)
    filled = F.array_join(F.zip_with(gaps, col(news), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    extra = lambda v: [v.cast("long").alias(count_col)] if count_col else []
    some = some.select(*[filled.alias(c) if c == text else col(c) for c in names], *extra(F.size(col(news))))
    none = docs.where(~has).select(*[t.alias(c) if c == text else col(c) for c in names], *extra(F.lit(0)))
    return none.unionByName(some)
