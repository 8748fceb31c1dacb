"""Surrogates for personal data (operator 10); DataFrame functions only.

Entities are e-mail addresses, phone, payment card (Luhn-valid), bank account (IBAN with right check digits) and US social
security numbers, IPv4 and IPv6 addresses, hexadecimal secrets after a quote, colon or equals sign, what a label such as
``password:`` or ``api_key =`` introduces, cloud access keys, and names after a title; in a text that has these, the same
names and their parts without a title too. Each is replaced by a surrogate of its type that is a keyed hash of its
canonical form: an address keeps its shape and top domain, a card its length, issuer digit and a right check digit, an
account its country and right check digits, a phone its country code and punctuation, a name its title, gender and
script. The same entity gets the same surrogate everywhere, however it is written (case, spacing). A name's surname and
what stands before it are entities of their own, so full and short forms of a name agree; Slavic surnames share one base
for both genders and end by the bearer's.

Collision checks: all distinct entities of the corpus and their surrogates are compared, and where a surrogate is
another entity's, or is itself an entity of the corpus, all but the first get their next attempt, until no two are equal.
Surrogates grow with the attempt (longer local parts, double given names, further syllables, more digits), so there are
always enough; only numbers of fixed length don't, and from ``REAL_FROM`` attempts on these may be another entity's number.
Texts are searched once, and only texts with entities are split and rewritten; only entities that needed another attempt
are looked up then, all others are computed in place.

Long texts: patterns take a text of any length, and what they repeat without bound they don't give back. A name that no title introduces, and
that is a common word too (``COMMON``), is rewritten in its full name only.

Nulls, ties: a null text stays null, without entities. Texts without entities come back unchanged. Repeated rows are
rewritten alike; empty tables give no rows. All other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, free_names

# What an entity looks like, in the order in which alternatives are tried.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}{2,}"  # a domain has 127 labels at most
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[A-Fa-f:]*\d)(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}}|::(?:{GROUP}:){{0,6}}{GROUP}|(?:{GROUP}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<![\d-])\d{9}(?![\d-])(?<=(?i:ssn|security number|security no\.)[:#=]{0,1} {0,1}\d{9})"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
LABEL = r"""(?<![\p{L}\p{N}])(?i:password|passwd|pwd|passphrase|secret|(?:api|access|secret|private)[ _-]?key|(?:auth|access)?[ _-]?token)["']? ?[:=] ?["']?"""
LABELLED = LABEL + r"""(?=[^\s"'<>,;]*\d)[^\s"'<>,;]{5,}[^\s"'<>,;.:!?)]"""
CLOUD = r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])"
PHONE = "|".join((
    r"(?<![\d+])\+\d{1,3}[ -]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\d+])\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\d+])\+\d(?:[ ./-]?\(?\d\)?){6,14}(?!\d)",  # E.164: 7 to 15 digits, however grouped
    r"(?<![\d(-])(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\(?\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    r"(?<![\p{L}\d.,+(/-])(?!\d{2}[/-]\d{2}[/-]\d{4}|\d{3}-\d{2}-\d{4})\(?0[1-9]\d{0,3}\)?[ /-]\d(?:[ /-]?\d){5,8}(?![\d-])",  # trunk prefix 0
))
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
SECRET = r"""(?<=["'=:]|[=:] )(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\p{N}])"""
MALE, FEMALE = "Mr|Mister|Sir|Lord|Herrn?|Señor|Sr|Don|Monsieur|Господин", "Mrs|Ms|Miss|Lady|Madam|Frau|Fräulein|Señora|Señorita|Sra|Srta|Doña|Madame|Mademoiselle|Mme|Mlle|Госпожа"
TITLE = f"{MALE}|{FEMALE}|Mx|Dr|Doctor|Doktor|Dra|Docteur|Prof|Professor|Professeur|Rev|Reverend|Judge|Capt|Captain|Доктор|Профессор"
#: Capitalised words that begin a sentence rather than go on with a name.
NOT_PART = "The|He|She|It|They|We|This|That|And|But|In|On|At|Der|Die|Das|Er|Sie|Es|Und|Aber|Im|Am|El|Los|Las|Ella|Pero|En|Il|Elle|Les|Mais|Он|Она|Они|Это|Но|В|На"
PART = rf"(?!(?:{NOT_PART}|{TITLE})(?![\p{{L}}'’-]))(?:\p{{Lu}}\.(?=(?: ?\p{{Lu}}\.){{0,8}}+ ?\p{{Lu}}(?:['’]\p{{Lu}})?[\p{{L}}\p{{M}}])|\p{{Lu}}(?:['’]\p{{Lu}})?[\p{{L}}\p{{M}}]+(?:['’][\p{{L}}\p{{M}}]{{2,}}|-[\p{{L}}\p{{M}}]+)*+)"
LINK = "van|von|vom|zu|zur|de|der|den|del|della|di|da|dos|du|la|le|ten|ter|bin|ibn|al|af|av|y"
#: Groups that repeat without bound are possessive: Java's matcher recurses for each repetition of others, and long texts would end it.
TITLES = rf"(?:(?:{TITLE})\.? )++"
NAME = rf"(?<!\p{{L}}){TITLES}(?:(?:{LINK}) ){{0,3}}{PART}(?: ?(?<=[. ])(?:(?:{LINK}) ){{0,3}}{PART})*+"
#: What may follow a name and is none of its parts.
SUFFIX = "(?<=[^ ]) (?:Jr|Jnr|Junior|II|III|IV)$"
#: Names that are common words too: alone and without a title they are left as they are.
COMMON = "April|August|June|March|May|Will"
#: A phone's country code: what stands apart, else by the numbering plan.
CODE = r"^\+(?:\d{1,3}(?=[ .(/-])|[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ENTITY = "|".join((EMAIL, IPV4, IPV6, PHONE, SSN, CARD, IBAN, LABELLED, CLOUD, SECRET, NAME))
#: Attempts after which a number of fixed length may be one that the corpus has.
REAL_FROM = 8
#: Slavic surnames of women, and what their bearers' fathers end by.
FEMALE_END, FEMALE_ADJ = "(?<=[оеё]в|[иы]н)а$", "(?<=[сц]к)ая$"
GIVEN = {
    ("m", "latin"): "Adam Anton Bruno Carl Daniel David Emil Felix Gabriel Henry Hugo Jacob Jonas Leo Lucas Marc Martin Noah Oscar Paul Robert Simon Thomas Victor",
    ("f", "latin"): "Alice Anna Bianca Carla Clara Diana Elena Emma Eva Flora Helena Ida Irene Julia Laura Lina Maria Nora Olivia Paula Rosa Sara Sofia Vera",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён",
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Зоя Инна Ирина Лариса Мария Нина Ольга Полина Раиса Софья",
}
GIVEN |= {("n", script): f"{GIVEN['m', script]} {GIVEN['f', script]}" for script in ("latin", "cyrillic")}
SURNAME = {
    "latin": ("Al Bar Bel Ber Bor Bran Cal Car Cor Dal Dor El Fal Far Gar Hal Har Kel Lan Mar Mel Nor Or Pal Per Ros Sal Sel Tal Tor Val Win", "a be da di do e fe ga la le li lo ma mi na ne ni o ra re ri ro sa se si so ta te ti to va ve", "berg bury dale feld field ford ham hart holm land ley lin low man mann mont more ner rick sen son stein ton vale ville ward way well wick win wood worth"),
    "cyrillic": ("Бар Бел Бор Вар Вол Гал Гор Дан Дол Дор Зар Кал Кар Кол Кор Лар Лот Мал Мар Мил Нал Нор Пал Пер Рад Сал Сор Тал Тар Тол Яр Ял", "а бе ва ви га го да до е за и ка ки ко ла ле ли ло ма ми мо на не ни но о ра ре ри са се та", "вин дов дин ев зин кин ков лев лин лов мин мов нев нин нов пин пов рев рин ров сев син сов тев тин тов хин хов цев чин чев шин"),
}


def _q(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _words(text: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in text.split()) + ")"


def remainder(t: str) -> str:
    """SQL for an account number's remainder by 97, its first four characters moved to the end."""
    return f"""aggregate(split(concat(substr({t}, 5), substr({t}, 1, 4)), ''), 0L, (a, c) -> CASE WHEN c = '' THEN a WHEN c rlike '[0-9]' THEN (a * 10 + cast(c as int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"""


def kind_of(e: str) -> str:
    """SQL for the kind of an entity; null for what only looks like one."""
    luhn = f"""aggregate(sequence(1, length(regexp_replace({e}, '[^0-9]', ''))), 0, (s, i) -> s + (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END)
        * cast(substr(regexp_replace({e}, '[^0-9]', ''), -i, 1) as int) - (CASE WHEN i % 2 = 0 AND cast(substr(regexp_replace({e}, '[^0-9]', ''), -i, 1) as int) > 4 THEN 9 ELSE 0 END)) % 10 = 0"""
    hexed = r'[0-9a-f]{32,64}$|[0-9A-F]{32,64}$'
    return f"""CASE WHEN {e} rlike {_q('^(?:' + LABEL + ')(?:' + hexed + ')')} THEN 'secret' WHEN {e} rlike {_q('^' + LABEL)} OR {e} rlike {_q('^(?:' + CLOUD + ')$')} THEN 'key'
        WHEN contains({e}, '@') THEN 'email' WHEN {e} rlike {_q('^' + IPV4 + '$')} THEN 'ip' WHEN {e} rlike {_q('^(?:' + IPV6 + ')$')} THEN 'ipv6' WHEN {e} rlike {_q('^(?:' + hexed + ')')} THEN 'secret'
        WHEN {e} rlike {_q(r'^[A-Z]{2}\d{2}[A-Z0-9 ]+$')} THEN IF({remainder(f"replace({e}, ' ')")} = 1, 'iban', NULL)
        WHEN {e} rlike {_q(r'^\p{L}')} THEN 'name' WHEN {e} rlike {_q(r'^(?:\d{3}-\d{2}-\d{4}|\d{9})$')} THEN 'ssn' WHEN {e} rlike {_q('^(?:' + PHONE + ')$')} THEN 'phone'
        WHEN {e} rlike '^[3-6]' AND {luhn} THEN 'card' END"""


def canonical(kind: str, e: str) -> str:
    """SQL for what all spellings of one entity share; of a name its gender and its words."""
    given = f"CASE WHEN {e} rlike {_q(f'^(?:{MALE})[. ]')} THEN 'm' WHEN {e} rlike {_q(f'^(?:{FEMALE})[. ]')} THEN 'f' ELSE 'n' END"
    return f"""CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN concat(regexp_extract({e}, {_q(CODE)}, 0), ' ', regexp_replace({e}, '[^0-9]', ''))
        WHEN {kind} = 'name' THEN concat({given}, ' ', regexp_replace(regexp_replace({e}, {_q('^' + TITLES)}, ''), {_q(SUFFIX)}, '')) WHEN {kind} = 'iban' THEN replace({e}, ' ')
        WHEN {kind} = 'key' THEN regexp_replace({e}, {_q('^' + LABEL)}, '') WHEN {kind} = 'secret' THEN lower(regexp_replace({e}, {_q('^' + LABEL)}, '')) ELSE lower({e}) END"""


def cyrillic(text: str) -> str:
    return f"({text} rlike {_q(r'\p{IsCyrillic}')})"


def given_of(name: str) -> str:
    """SQL for the entity of what stands before a name's surname; null where nothing does."""
    return f"CASE WHEN substr({name}, 3) like '% %' THEN regexp_replace({name}, ' [^ ]+$', '') END"


def surname_of(name: str) -> str:
    last = f"substring_index({name}, ' ', -1)"
    return f"concat('s ', CASE WHEN {name} like 'm %' THEN {last} ELSE regexp_replace(regexp_replace({last}, {_q(FEMALE_END)}, ''), {_q(FEMALE_ADJ)}, 'ий') END)"


def keys_of(x: str) -> str:
    """SQL for the (kind, canon) entities of a mention."""
    return f"""CASE WHEN {x}.kind = 'name' THEN filter(array(named_struct('kind', 'given', 'canon', {given_of(x + '.canon')}), named_struct('kind', 'surname', 'canon', {surname_of(x + '.canon')})), k -> k.canon IS NOT NULL)
        WHEN {x}.kind IS NOT NULL THEN array(named_struct('kind', {x}.kind, 'canon', {x}.canon)) END"""


def surrogate(kind: str, canon: str, attempt: str, key: str, chars: int = 64) -> str:
    """SQL for the canonical form of the surrogate. ``chars`` shortens the hash, for tests of collisions."""
    h = f"repeat(substr(sha2(concat_ws('\\n', '{key}', {kind}, {canon}, {attempt}), 256), 1, {chars}), {64 // chars})"
    digits = f"regexp_extract({canon}, '[0-9]+$', 0)"
    code = f"regexp_extract({canon}, {_q(r'^\+(\d*)')}, 1)"
    byte = lambda i: f"cast(conv(substr(h, 1 + (2 * ({i})) % 63, 2), 16, 10) as int)"
    number = lambda n: f"translate(substr(repeat(h, 2), 1, {n}), 'abcdef', '173958')"

    def shaped(text: str, hexadecimal: bool = False) -> str:
        letters = f"WHEN c rlike '[0-9a-f]' THEN substr('0123456789abcdef', 1 + {byte('i')} % 16, 1)" if hexadecimal else f"WHEN c rlike '[0-9]' THEN cast({byte('i')} % 10 as string)"
        return f"""array_join(transform(split({text}, ''), (c, i) -> CASE {letters} WHEN c rlike '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {byte('i')} % 26, 1)
            WHEN {cyrillic('c')} THEN substr('абвгдежзиклмнопрстуфхцчшэюя', 1 + {byte('i')} % 27, 1)
            WHEN c rlike {_q(r'\p{L}')} THEN substr('abcdefghijklmnopqrstuvwxyz', 1 + {byte('i')} % 26, 1) ELSE c END), '')"""

    more = f"greatest({attempt} - 1, 0)"  # by how much a surrogate is longer
    local = f"concat(substring_index({canon}, '@', 1), repeat('x', {more}), '@', regexp_extract({canon}, {_q(r'@(.*)\.')}, 1))"
    body = f"concat(substr({digits}, 1, 1), {number(f'length({digits}) - 2')})"
    check = f"""cast((10 - aggregate(sequence(1, length(b)), 0, (s, i) -> s + (CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END) * cast(substr(b, -i, 1) as int)
        - (CASE WHEN i % 2 = 1 AND cast(substr(b, -i, 1) as int) > 4 THEN 9 ELSE 0 END)) % 10) % 10 as string)"""
    account = f"concat(substr({canon}, 1, 2), lpad(cast(98 - {remainder('b')} as string), 2, '0'), substr(b, 5))"
    pick = lambda words, i: f"element_at({_words(words)}, 1 + {byte(i)} % {len(words.split())})"
    names = "CASE " + " ".join(
        f"WHEN substr({canon}, 1, 1) = '{g}' AND {cyrillic(canon)} = {str(s == 'cyrillic').lower()} THEN array_join(transform(sequence(0, {attempt} div 2), j -> {pick(words, '5 * j')}), '-')" for (g, s), words in GIVEN.items()
    ) + " END"
    last = "CASE " + " ".join(
        f"WHEN {cyrillic(canon)} = {str(s == 'cyrillic').lower()} THEN concat({pick(parts[0], '1')}, array_join(transform(sequence(0, {attempt} div 2), j -> {pick(parts[1], '2 + 3 * j')}), ''), {pick(parts[2], '3')})" for s, parts in SURNAME.items()
    ) + " END"
    octets = f"IF({attempt} < {REAL_FROM}, concat_ws('.', 1 + {byte(0)} % 223, {byte(1)}, {byte(2)}, 1 + {byte(3)} % 254), concat_ws('.', {byte(0)}, {byte(1)}, {byte(2)}, {byte(3)}))"
    # the hash is computed once: a one-element array stands in for a binding
    return f"""element_at(transform(array({h}), h -> CASE {kind}
        WHEN 'email' THEN concat({shaped(local)}, regexp_extract({canon}, {_q(r'\.[^.]*$')}, 0))
        WHEN 'ip' THEN {octets}
        WHEN 'ipv6' THEN {shaped(f"IF({attempt} < 3, {canon}, '0000:0000:0000:0000:0000:0000:0000:0000')", True)}
        WHEN 'secret' THEN substr(h, 1, length({canon}))
        WHEN 'key' THEN concat(regexp_extract({canon}, '^(?:AKIA|ASIA)(?=[0-9A-Z]{{16}}$)', 0), {shaped(f"concat(regexp_replace({canon}, '^(?:AKIA|ASIA)(?=[0-9A-Z]{{16}}$)', ''), repeat('x', {more}))")})
        WHEN 'card' THEN element_at(transform(array({body}), b -> concat(' ', b, {check})), 1)
        WHEN 'iban' THEN element_at(transform(array(concat(substr({canon}, 1, 2), '00', {shaped(f'substr({canon}, 5)')})), b -> {account}), 1)
        WHEN 'ssn' THEN concat(' ', {number('9')})
        WHEN 'phone' THEN concat(regexp_extract({canon}, '^[+0-9]*', 0), ' ', {code}, {number(f'length({digits}) - length({code}) + greatest({attempt} - 2, 0)')})
        WHEN 'given' THEN {names}
        ELSE {last} END), 1)"""


def written(x: str, s: str, g: str) -> str:
    """SQL for the mention ``x`` in its own spelling: ``s`` is its surrogate (of a name the surname's), ``g`` that of the given names."""
    kind, e, canon = f"{x}.kind", f"{x}.e", f"{x}.canon"
    fill = lambda slot, source: f"""aggregate(split({e}, ''), named_struct('t', '', 'd', {source}), (a, c) -> CASE WHEN c rlike '{slot}'
        THEN named_struct('t', concat(a.t, substr(a.d, 1, 1)), 'd', substr(a.d, 2)) ELSE named_struct('t', concat(a.t, c), 'd', a.d) END, a -> concat(a.t, a.d))"""  # noqa: E731
    case = f"array_join(zip_with(split({e}, ''), split({s}, ''), (c, d) -> CASE WHEN c <> lower(c) THEN upper(d) ELSE coalesce(d, '') END), '')"
    bare = f"regexp_replace(regexp_replace({e}, {_q('^' + TITLES)}, ''), {_q(SUFFIX)}, '')"
    suffix = f"regexp_extract(regexp_replace({e}, {_q('^' + TITLES)}, ''), {_q(SUFFIX)}, 0)"
    label = f"regexp_extract({e}, {_q('^' + LABEL)}, 0)"
    female = f"{cyrillic(canon)} AND ({canon} like 'f %' OR {canon} like 'n %' AND {canon} rlike {_q(FEMALE_END + '|' + FEMALE_ADJ)})"
    last = f"concat({s}, IF({female}, 'а', ''))"
    name = f"""concat(regexp_extract({e}, {_q('^' + TITLES)}, 0), CASE WHEN {bare} = substr({canon}, 3) THEN concat_ws(' ', {g}, {last})
        WHEN {bare} = substring_index({canon}, ' ', -1) THEN {last} ELSE {g} END, {suffix})"""
    return f"""CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN {fill('[0-9]', f"regexp_extract({s}, '[0-9]+$', 0)")} WHEN {kind} = 'iban' THEN {fill('[0-9A-Z]', s)} WHEN {kind} = 'name' THEN {name} WHEN {kind} = 'ip' THEN {s}
        WHEN {kind} = 'key' THEN concat({label}, {s}) WHEN {kind} = 'secret' THEN concat({label}, IF({e} rlike '[0-9A-F]{{32}}' AND NOT {e} rlike '[0-9a-f]{{32}}', upper({s}), {s})) ELSE {case} END"""


def entities(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with ents: array of (e, kind, canon), null where the text has none, and bare: what finds its names without a title.

    A text with titled names is searched for these names, and their parts, where no title stands before them."""
    likely = F.col("text").rlike(rf"[0-9@]|(?:{TITLE})\.? ")
    raw = F.when(likely, F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    titled = f"""transform(array_distinct(filter(raw, e -> e rlike {_q('^' + TITLES)} AND NOT contains(e, '@'))), e -> {canonical("'name'", 'e')})"""
    part = f"""filter(split(substr(n, 3), ' '), (w, i) -> w rlike {_q(r'^\p{Lu}[^.]')})"""
    words = f"filter(array_distinct(flatten(transform(names, n -> concat(array(substr(n, 3)), {part})))), w -> NOT w rlike '^(?:{COMMON})$')"
    longest = f"array_sort({words}, (a, b) -> length(b) - length(a))"
    quote = lambda w: rf"concat('\\Q', {w}, '\\E')"
    # names that begin alike share a branch, so that a place of the text is not compared with all of them
    branch = f"concat({quote('p')}, '(?:', array_join(transform(filter(spoken, w -> startswith(w, p)), w -> {quote('substr(w, 3)')}), '|'), ')')"
    bare = rf"""concat({_q(r'(?<![\p{L}\p{M}])(?:')}, array_join(transform(array_distinct(transform(spoken, w -> substr(w, 1, 2))), p -> {branch}), '|'), {_q(r')(?![\p{L}\p{M}])')})"""
    found = docs.withColumn("raw", raw).withColumn("raw", F.when(F.size("raw") > 0, F.col("raw"))).withColumn("names", F.expr(titled))
    found = found.withColumn("spoken", F.when(F.size("names") > 0, F.expr(longest)))
    found = found.withColumn("bare", F.when(F.size("spoken") > 0, F.expr(bare)))
    found = found.withColumn("raw", F.when(F.col("bare").isNotNull(), F.regexp_extract_all("text", pattern(), F.lit(0))).otherwise(F.col("raw")))
    typed = F.expr(f"transform(raw, e -> named_struct('e', e, 'kind', {kind_of('e')}))")
    # an untitled mention is the first of the text's names that it is, else of which it is a part
    parts = "transform(names, n -> split(substr(n, 3), ' '))"
    found = found.withColumn("said", F.expr(f"concat(transform(names, n -> substr(n, 3)), flatten({parts}))"))
    found = found.withColumn("whose", F.expr(f"concat(transform(names, (n, i) -> i), flatten(transform({parts}, (w, i) -> array_repeat(i, size(w)))))"))
    # both are named twice, so that they are computed once a text and not once a mention
    own = "IF(size(said) + size(whose) > 0, get(names, get(whose, cast(array_position(said, x.e) as int) - 1)), NULL)"
    named = f"CASE WHEN x.kind = 'name' AND NOT x.e rlike {_q('^' + TITLES)} THEN {own} ELSE {canonical('x.kind', 'x.e')} END"
    full = F.expr(f"transform(typed, x -> named_struct('e', x.e, 'kind', x.kind, 'canon', {named}))")
    return found.withColumn("typed", typed).withColumn("ents", full).drop("raw", "typed", "names", "spoken", "said", "whose")


def pattern():
    """What a text's entities are found and split by."""
    return F.concat(F.lit(ENTITY), F.coalesce(F.concat(F.lit("|"), F.col("bare")), F.lit("")))


def attempts(found: DataFrame, key: str, chars: int = 64) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate collides."""
    spoken = found.where("ents is not null").select(F.explode("ents").alias("x")).select(F.explode(F.expr(keys_of("x"))).alias("k"))
    now = cut(spoken.select("k.kind", "k.canon").distinct().withColumn("attempt", F.lit(0)), "entities")
    originals = now.select("kind", F.expr("IF(kind IN ('given', 'surname'), substr(canon, 3), canon)").alias("s"), F.lit(True).alias("real")).distinct()
    fixed = f"kind IN ('ip', 'ssn', 'card', 'iban') AND -owner.attempt >= {REAL_FROM}"
    while True:
        made = now.withColumn("s", F.expr(surrogate("kind", "canon", "attempt", key, chars)))
        # one row per surrogate, summed in tasks first; who came first to it keeps it, unless it is a real entity
        first = made.groupBy("kind", "s").agg(F.min(F.struct((-F.col("attempt")).alias("attempt"), "canon")).alias("owner"), F.count("*").alias("n"))
        real = F.expr(f"coalesce(real, false) AND NOT ({fixed})")
        bad = first.join(originals, ["kind", "s"], "left").withColumn("real", real).where("n > 1 or real").select("kind", "s", F.when(~F.col("real"), F.col("owner.canon")).alias("stays"))
        bad = cut(bad, "collisions")
        if bad.isEmpty():
            return now.where("attempt > 0")
        again = made.join(bad.withColumn("hit", F.lit(True)), ["kind", "s"], "left").select("kind", "canon", (F.col("attempt") + F.when(F.col("hit") & ~F.col("canon").eqNullSafe(F.col("stays")), 1).otherwise(0)).alias("attempt"))
        now = cut(again, "entities")


def pseudonymise(docs: DataFrame, key: str, chars: int = 64) -> DataFrame:
    """``docs`` with its text rewritten, and after its columns pii: the kinds in order of their mentions (``_pii`` where there is a pii)."""
    names, (pii,) = docs.columns, free_names(docs, "pii")
    at = names.index("text")
    # columns are numbered from here on, so that no name of theirs meets a helper's
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumnRenamed(f"c{at}", "text")
    found = cut(entities(numbered.withColumn("text", F.col("text").cast("string"))), "found")
    more = cut(attempts(found, key, chars), "attempts")
    columns = ["text" if i == at else f"c{i}" for i in range(len(names))]
    plain = found.where("ents is null").select(*columns, F.expr("cast(array() as array<string>)").alias("kinds"))
    some = found.where("ents is not null")
    number = lambda kind, canon: "0"
    if not more.isEmpty():
        # by text, so that copies of one text ask once; the table of attempts holds colliding entities only
        some = some.withColumn("own", F.sha2("text", 256))
        asked = some.select("own", F.explode("ents").alias("x")).select("own", F.explode(F.expr(keys_of("x"))).alias("k")).select("own", "k.*").distinct()
        numbers = asked.join(more, ["kind", "canon"]).groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\n", "kind", "canon"), "attempt"))).alias("tries"))
        some = some.join(numbers, "own", "left")
        number = lambda kind, canon: f"coalesce(tries[concat_ws('\\n', {kind}, {canon})], 0)"

    def of(kind: str, canon: str) -> str:
        return surrogate(kind, canon, number(kind, canon), key, chars)

    new = f"""element_at(transform(array(CASE WHEN x.kind = 'name' THEN named_struct('s', {of("'surname'", surname_of('x.canon'))}, 'g', {of("'given'", given_of('x.canon'))})
        ELSE named_struct('s', {of('x.kind', 'x.canon')}, 'g', cast(NULL as string)) END), s -> {written('x', 's.s', 's.g')}), 1)"""
    replaced = some.withColumn("parts", F.split("text", pattern(), -1)).withColumn("new", F.expr(f"transform(ents, x -> CASE WHEN x.kind IS NULL THEN x.e ELSE {new} END)"))
    rebuilt = F.expr("array_join(flatten(zip_with(parts, new, (p, r) -> array(p, coalesce(r, '')))), '')")
    kinds = F.expr("transform(filter(ents, x -> x.kind is not null), x -> x.kind)").alias("kinds")
    written_rows = replaced.select(*[rebuilt.alias(c) if c == "text" else F.col(c) for c in columns], kinds)
    return plain.unionByName(written_rows).toDF(*names, pii)


def report(docs: DataFrame, key: str = "quillon") -> DataFrame:
    """(doc_id, text, n_pii, pii) of every document."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join("pii", ",").alias("pii"))
