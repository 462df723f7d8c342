"""Rules over elements (doc_id, ord, type, level, text, section, id).

Most rules are columns of array<finding>, so one pass reads each text once for all of them. What a rule needs of
the rest of its document comes from windows that share one shuffle by doc_id (in_context). Rules that compare
elements with one another are joins of the narrow columns that the same pass leaves (marked).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import (
    EDGE_LEFT, EDGE_RIGHT, NOT_WS, WS, at_hits, collapsed, cut, hits, let, piece, sign_count, spliced, Stack, stacks_after, trimmed, window,
)
from docaudit.sources.paragraphs import in_order

# Categories, priorities and wording of findings.
BRACKETS, QUOTES, MARKDOWN, SPACING = "Zagrade", "Tipografija", "Markdown artefakt", "Razmaci"
SCRIPT, GREEK, DOUBLED, TOC = "Mešanje pisama", "Grčki bez prevoda", "Duple reči", "TOC/naslovi"
NUMBERING, BIBLIOGRAPHY, URL, NOTES = "Numeracija", "Bibliografija", "URL", "Fusnote"
REPETITION, CAPITALS, STRUCTURE = "Ponavljanje", "ALL-CAPS", "Struktura"
MUST, CHECK, SHOULD = "OBAVEZNO", "PROVERITI", "PREPORUKA"
CODE_WORDS = (
    "if|else|for|while|do|switch|case|try|catch|finally|function|const|let|var|return|class|import|export|def|public|private|protected|"
    "void|int|string|bool|async|await|interface|type|enum|namespace|struct|record|package"
)
PREFIXES = (
    "mailto|tel|urn|ftp|ssh|git|svn|site|inurl|filetype|intitle|intext|cache|link|info|related|define|"
    "w|r|m|ns|mc|wp|v|a|o|c|dc|cp|xsi|xsd|xml"
)
MAY_REPEAT = ["ha", "da", "ne", "vrlo", "još", "baš", "sve", "sam", "ni", "to", "što"]
ACRONYMS = (
    "UNESCO NATO EU SAD SSSR DNA RNA URL HTML CSS JS PDF DOCX ISBN ISSN DOI NB PS AD BC PhD USA UK ID OK IT PR HR TV CD DVD USB PC OS AI "
    "NSP JSON XML OOXML CSV NLP ODT OCR API SQL SSH HTTP HTTPS FTP SMTP TCP UDP DNS SSL TLS JWT YAML TOML GNU GPL MIT BSD GDPR WCAG WAI "
    "ARIA RFC ISO IEEE ACM"
).split()
BIBLIOGRAPHY_TITLES = (
    "bibliografija|literatura|izvori i literatura|references|works cited|bibliography|primarni izvori|sekundarni izvori|arhivski izvori|"
    "korišćena literatura|spisak literature|библиографија|литература|примарни извори|секундарни извори|архивски извори"
)
ANCIENT = (
    "Herodot(us)?|Thucydides|Plutarch|Diodorus|Strabo|Pausanias|Appian|Apijan|Josephus|Flavius|Pseudo-|Homer|Hesiod|Plato|Platon|Aristotle|"
    "Aristot|Cicero|Tacitus|Livius|Plinius|Ptolemy|Euripides|Sophocles|Aeschylus|Xenophon|Polybius|Apollodorus|Bibliotheca|Historiae|"
    "Antiquitates|Annales"
)
RELIGIOUS = "Biblija|Bible|Sveto Pismo|Quran|Talmud|Torah"
PERIODICALS = r"Journal|Review|Bulletin|Proceedings|Annals|Quarterly|Vol\.|Issue|pp\.|str\."
NOT_AUTHORS = (
    "Beograd Zagreb Sarajevo London Oxford Cambridge Berlin Paris Roma Athens Chicago Moscow Moskva Atina Review Journal Press University "
    "Institut Academy Society Edition Volume Chapter"
).split()
MARKDOWN_PATTERNS = [
    (r"(?m)(?:^|[\s(\[{])(\*\*(?:[^*]|\*(?!\*))+\*\*)(?=[.,;:!?\s)\]}\-]|$)", "**bold**"),
    (r"(?m)(?:^|[\s(\[{])(\*(?:[^*])+\*)(?=[.,;:!?\s)\]}\-]|$)", "*italic*"),
    (r"(?m)(?:^|[\s(\[{])(__(?:[^_]|_(?!_))+__)(?=[.,;:!?\s)\]}\-]|$)", "__bold__"),
    (r"(?m)(?:^|[\s(\[{])(_[^_]+_)(?=[.,;:!?\s)\]}\-]|$)", "_italic_"),
    (r"(?m)^#{1,6}\s", "# naslov"),
    (r"(?m)^\s*[-*+]\s", "- lista"),
    (r"(?m)^\s*>\s", "> blockquote"),
    (r"\[([^\]]+)\]\([^)]+\)", "[link](url)"),
    (r"```", "```"),
    (r"(?:^|\s)`[^`]+`(?:\s|\z)", "`code`"),
]
WORD = r"[\p{L}\p{M}]+"
GREEK_RUN = r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}](?:[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF},;\x{00B7}.'\x{0022}\x{0300}-\x{036F}\x{1DC0}-\x{1DFF}]|" + WS + "){2,}"

FINDING = (
    "array<struct<rule_id:string,category:string,priority:string,confidence:double,original:string,replacement:string,rationale:string,"
    "auto_fixable:boolean,requires_source_verification:boolean,global_pattern:boolean,check_ord:int,sub_ord:int,match_pos:int>>"
)


def finding(
    rule: str, category: str, priority: str, confidence, original, replacement, rationale, check: int, sub: int = 0, pos=None, fix: bool = False,
    source: bool = False, whole: bool = False,
) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(priority).alias("priority"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
        text(original).alias("original"), text(replacement).alias("replacement"), text(rationale).alias("rationale"), F.lit(fix).alias("auto_fixable"),
        F.lit(source).alias("requires_source_verification"), F.lit(whole).alias("global_pattern"), F.lit(check).alias("check_ord"), F.lit(sub).alias("sub_ord"),
        (F.lit(0) if pos is None else pos).cast("int").alias("match_pos"),
    )


def quoted(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def spacing(text: Column, rule: str = "spacing_body", kinds: tuple[int, ...] = (1, 2, 3, 4, 5), radius: int = 25) -> Column:
    """Double spaces; spaces before marks and closers; spaces after openers; no space after , ; :"""
    def last(x: Column, k: int) -> Column:
        return F.substring(x["m"], F.length(x["m"]) - (k - 1), F.lit(k))

    def made(t: Column, x: Column, sub: int, priority: str, sure: float, why, new: Column, size: Column | None = None) -> Column:
        to = spliced(t, x["pos"], 20, F.length(x["m"]) if size is None else size, new)
        return finding(rule, SPACING, priority, sure, window(t, x["pos"], 20), to, why, 3, sub, x["pos"], fix=True)

    def double(t: Column, x: Column) -> Column:
        around = window(t, x["pos"], radius)
        return finding(rule, SPACING, MUST, 0.99, around, F.regexp_replace(around, "  +", " "), "Višestruki razmak.", 3, 1, x["pos"], fix=True)

    def before(t: Column, x: Column) -> Column:
        return made(t, x, 2, MUST, 0.97, quoted("Razmak pre „", last(x, 1), "“."), last(x, 1))

    def before_ok(t: Column, x: Column) -> Column:
        ahead = piece(t, F.greatest(F.lit(0), x["pos"] - 5), F.least(F.lit(5), x["pos"]))
        rest = piece(t, x["pos"] + F.length(x["m"]), 2)
        return ~ahead.rlike("https?:\\z") & ~((last(x, 1) == ".") & (rest == ".."))

    def closer(t: Column, x: Column) -> Column:
        return made(t, x, 3, SHOULD, 0.90, "Razmak pre zatvorene zagrade.", last(x, 1))

    def opener(t: Column, x: Column) -> Column:
        return made(t, x, 4, SHOULD, 0.90, "Razmak posle otvorene zagrade.", F.substring(x["m"], 1, 1))

    def after(t: Column, x: Column) -> Column:
        mark = F.substring(x["m"], 1, 1)
        return made(t, x, 5, MUST, 0.85, quoted("Nedostaje razmak posle „", mark, "“."), F.concat(mark, F.lit(" "), last(x, 1)), F.lit(2))

    def after_ok(t: Column, x: Column) -> Column:
        start = F.greatest(F.lit(0), x["pos"] - 10)
        near = piece(t, start, x["pos"] + 10 - start)
        return ~near.rlike(r"https?:|[A-Za-z0-9_]:\\|[0-9a-fA-F]{2}:[0-9a-fA-F]") & ~near.rlike(f"(?iu)({PREFIXES}):")

    unspaced = r"[,;:][^\d\x{0022}'\x{201C}\x{201D}\x{201E}\x{2019})\]" + WS[1:]
    of = {
        1: ("  +", double, None), 2: (" +[,.:;!?]", before, before_ok), 3: (r" +[)\]}»\x{201C}]", closer, None),
        4: (r"[(\[{«\x{201E}] +", opener, None), 5: (unspaced, after, after_ok),
    }
    return merged([at_hits(text, *of[k]) for k in kinds])


def script_mix(text: Column, rule: str = "script_mixing_body") -> Column:
    """Words of two letters or more with Cyrillic and Latin ones."""
    cyrillic, latin = r"[\x{0400}-\x{04FF}]", r"[a-zA-Z\x{00C0}-\x{024F}]"

    def made(w: Column) -> Column:
        c, n = F.regexp_count(w, F.lit(cyrillic)), F.regexp_count(w, F.lit(latin))
        return finding(
            rule, SCRIPT, MUST, 0.96, w, quoted("[prebaciti na ", F.when(c > n, "ćirilica").otherwise("latinica"), "]"),
            quoted("Reč „", w, "“: ", c.cast("string"), " ćir. + ", n.cast("string"), " lat."), 4,
        )

    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= 2) & w.rlike(cyrillic) & w.rlike(latin))
    return F.when(text.rlike(cyrillic) & text.rlike(latin), F.transform(words, made)).otherwise(F.lit(None).cast(FINDING))


def greek(text: Column, rule: str = "greek_body") -> Column:
    """Greek runs with no translation in brackets or quotes near by."""
    near = r"[(\x{201E}\x{201A}\x{0022}][^)\x{0022}\x{201C}]*[\x{0400}-\x{04FF}a-zA-Z\x{00C0}-\x{024F}]{5,}[^)\x{0022}\x{201C}]*[)\x{0022}\x{201C}]"

    def bare(t: Column, x: Column) -> Column:
        after = piece(t, x["pos"] + F.length(x["m"]), 150)
        start = F.greatest(F.lit(0), x["pos"] - 100)
        before = piece(t, start, x["pos"] - start)
        return ~after.rlike(near) & ~before.rlike(r"[(\x{201E}\x{201A}].*[\x{0400}-\x{04FF}a-zA-Z]{5,}.*[)\x{201C}\x{0022}]") & ~(before.rlike(f"\\({WS}*\\z") & after.rlike(f"^{WS}*\\)"))

    def made(t: Column, x: Column) -> Column:
        snip = F.when(F.length(x["m"]) > 40, F.concat(F.substring(x["m"], 1, 40), F.lit("..."))).otherwise(x["m"])
        return finding(rule, GREEK, CHECK, 0.75, snip, "[dodati prevod]", "Grčki bez prevoda u blizini.", 5, pos=x["pos"], source=True)

    return merged([at_hits(text, GREEK_RUN, made, bare)])


DOUBLE_WORD = f"(?iu)(?<!{NOT_WS})(\\p{{L}}++){WS}++\\1(?={WS}|[,.:;!?)\\]}}]|\\z)"


def duplicate_words(text: Column, rule: str = "duplicate_words_body") -> Column:
    """A word twice in a row, whatever the case, within a line."""
    word = lambda m: F.regexp_extract(m, f"^(\\p{{L}}+){WS}", 1)
    found = F.flatten(F.transform(F.split(text, "\n", -1), lambda line: F.regexp_extract_all(line, F.lit(DOUBLE_WORD), F.lit(0))))
    kept = F.filter(found, lambda m: (F.length(word(m)) >= 2) & ~F.lower(word(m)).isin(MAY_REPEAT))
    made = lambda m: finding(rule, DOUBLED, MUST, 0.95, m, word(m), quoted("Ponovljena reč „", word(m), "“."), 6, fix=True)
    return F.transform(kept, made)


def urls(text: Column, rule: str = "urls_body", long: bool = True) -> Column:
    """Addresses that end in a mark or an unopened bracket, or are over 100 characters long."""
    pattern = r"https?://(?:(?![<>\x{0022}{}|\\^`\[\]])" + NOT_WS + ")+"

    def made(u: Column) -> Column:
        ends, opened, closed = u.rlike(r"[,.;]+\z"), F.regexp_count(u, F.lit(r"\(")), F.regexp_count(u, F.lit(r"\)"))
        a = F.when(ends, finding(rule, URL, CHECK, 0.80, u, F.regexp_replace(u, r"[,.;]+\z", ""), "URL završen interpunkcijom.", 10)).when(
            u.endswith(")") & (closed > opened), finding(rule, URL, CHECK, 0.70, u, F.regexp_replace(u, r"\)\z", ""), "Zatvorena zagrada verovatno nije deo URL-a.", 10)
        )
        b = F.when(F.length(u) > 100, finding(rule, URL, SHOULD, 0.65, F.concat(F.substring(u, 1, 50), F.lit("...")), "[proveriti]", "Veoma dugačak URL.", 10, 1))
        return F.array_compact(F.array(a, b) if long else F.array(a))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made))


def markdown_left(text: Column, rule: str = "markdown_body", patterns=MARKDOWN_PATTERNS) -> Column:
    """Remains of Markdown in texts that aren't."""
    def kind(n: int, p: str, name: str) -> Column:
        p = p.replace("[\\s(", "[" + WS[1:-1] + "(").replace("!?\\s)", "!?" + WS[1:-1] + ")").replace("\\s", WS)
        made = lambda m: finding(rule, MARKDOWN, MUST, 0.92, trimmed(m), "[ukloniti markdown]", f"Ostatak {name}.", 2, n)
        return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), made)

    return F.concat(*[kind(n, p, name) for n, (p, name) in enumerate(patterns)])


# ---- brackets

def code_like(text: Column) -> Column:
    return (
        text.rlike(f"(?iu)^{WS}*({CODE_WORDS}){EDGE_RIGHT}") | text.rlike(f"^{WS}*[{{}}();]+{WS}*\\z") | text.rlike(f"^{WS}*(//|#|/\\*)")
        | text.rlike(r"\$\([^)\r\n]*\)\.|=>|->|\.then\(|\.catch\(|require\(|import" + WS + r"+\{") | (text.rlike("[{;]" + WS + "*\\z") & text.rlike(r"[=<>!&|+\-*/%]"))
    )


ROMAN = r"(?iu)^(?=[IVXLCDM]+\z)M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})\z"


PAIRS = ("()", "[]", "{}")


def list_marks(text: Column) -> Column:
    """Places of closing brackets after a number, a letter or a Roman numeral that begins a line."""
    def listed(x: Column) -> Column:
        token = trimmed(F.substring(x["m"], F.lit(1), F.length(x["m"]) - 1))
        return token.rlike(r"^\d+\z") | token.rlike(r"^\p{L}\p{M}*\z") | (token.rlike(ROMAN) & (token != ""))

    heads = F.filter(hits(text, r"(?<![^\n])[^()\[\]{}\n]*\)"), listed)
    return F.transform(heads, lambda x: x["pos"] + F.length(x["m"]) - 1)


def bracket_errors(text: Column, code: Column | None = None, markers: bool = True) -> Column:
    """array<struct<kind, pos, close, open, open_pos>>: one walk over the brackets. A closer takes the last open bracket
    of its own kind, so each kind has a stack of its own; where one of another kind was opened later and is still
    open, they cross. A closer without any is an orphan. Where nothing is open, closers of list items and of braces in
    code-like text are let pass. No step looks at more than the stacks' ends, so a line costs what it is long."""
    code = F.lit(False) if code is None else code
    signs = F.filter(F.transform(F.split(text, "", -1), lambda c, i: F.struct(i.alias("pos"), c.alias("c"))), lambda x: x["c"].isin(*"([{)]}"))
    kinds = {f"s{k}": pair for k, pair in enumerate(PAIRS)}

    def walk(of: Column) -> Column:
        listed, code = of["listed"], of["code"]

        def step(stacks: dict[str, Stack], x: Column) -> list:
            c, pos = x["c"], x["pos"]
            none_open = reduce(lambda a, b: a & b, [stacks[k].top().isNull() for k in kinds])
            out = [(none_open & ((code & (c == "}")) | ((c == ")") & F.array_contains(listed, pos))), {})]
            error = lambda at: {"at": stacks["at"].pushed(pos), "open": stacks["open"].pushed(at)}
            for k, (opens, closes) in kinds.items():
                mine = stacks[k].top()
                crossed = F.greatest(*[F.coalesce(stacks[j].top(), F.lit(-1)) for j in kinds]) > mine
                out += [
                    (c == opens, {k: stacks[k].pushed(pos)}), ((c == closes) & mine.isNull(), error(F.lit(-1))),
                    ((c == closes) & crossed, error(mine) | {k: stacks[k].popped()}), (c == closes, {k: stacks[k].popped()}),
                ]
            return out

        def told(found: Column) -> Column:
            letters = F.split(text, "", -1)
            met = F.arrays_zip(found["at"].alias("pos"), found["open"].alias("open_pos"))
            left = F.array_sort(F.concat(found["s0"], found["s1"], F.when(code, F.expr("cast(array() as array<int>)")).otherwise(found["s2"])))
            return let(letters, lambda sign: F.concat(
                F.transform(met, lambda e: F.struct(
                    F.when(e["open_pos"] < 0, "orphan_close").otherwise("crossed").alias("kind"), e["pos"].alias("pos"), F.get(sign, e["pos"]).alias("close"),
                    F.get(sign, e["open_pos"]).alias("open"), F.when(e["open_pos"] >= 0, e["open_pos"]).alias("open_pos"))),
                F.transform(left, lambda p: F.struct(
                    F.lit("unclosed_open").alias("kind"), p.alias("pos"), F.translate(F.get(sign, p), "([{", ")]}").alias("close"),
                    F.get(sign, p).alias("open"), p.alias("open_pos"))),
            ))

        return let(stacks_after(signs, [*kinds, "at", "open"], step), told)

    none_listed = F.expr("cast(array() as array<int>)")
    marks = F.when(text.contains(")"), list_marks(text)).otherwise(none_listed) if markers else none_listed
    none = F.expr("cast(array() as array<struct<kind:string,pos:int,close:string,open:string,open_pos:int>>)")
    return F.when(text.rlike(r"[()\[\]{}]"), let(F.struct(marks.alias("listed"), code.alias("code")), walk)).otherwise(none)


def brackets(text: Column, balanced: Column, rule: str = "unbalanced_brackets_body") -> Column:
    """Crossed, orphan and unclosed brackets. Orphans and unclosed ones of a kind are let pass where balanced
    (struct<b0,b1,b2>, see in_context) says so of it."""
    def of(e: Column) -> tuple[Column, Column]:
        kind = F.coalesce(e["open"], F.translate(e["close"], ")]}", "([{"))
        level = F.when(kind == "(", balanced["b0"]).when(kind == "[", balanced["b1"]).otherwise(balanced["b2"])
        return level, F.when(kind == "(", "obla").when(kind == "[", "uglasta").otherwise("vitičasta")

    def made(t: Column, e: Column) -> Column:
        close, open_, pos = e["close"], e["open"], e["pos"]
        name = of(e)[1]
        to = F.when(e["kind"] == "crossed", quoted("[ukrštene zagrade: ", open_, "...", close, "]")).when(
            e["kind"] == "orphan_close", quoted("[ukloniti višak „", close, "“]")
        ).otherwise(quoted("[dodati „", close, "“]"))
        crossed = quoted("Ukrštene zagrade: ", open_, " na poziciji ", e["open_pos"].cast("string"), " zatvorena sa ", close, " na poziciji ", pos.cast("string"), ".")
        why = F.when(e["kind"] == "crossed", crossed).when(
            e["kind"] == "orphan_close", quoted("Zatvorena zagrada ", close, " bez odgovarajuće otvorene.")
        ).otherwise(quoted("Otvorena ", name, " zagrada bez zatvorene."))
        sure = F.when(e["kind"] == "crossed", 0.95).otherwise(0.98)
        return finding(rule, BRACKETS, MUST, sure, window(t, pos, 40), to, why, 0, 0, pos)

    errors = F.filter(bracket_errors(text, code_like(text)), lambda e: (e["kind"] == "crossed") | ~of(e)[0])
    return F.when(text.rlike(r"[()\[\]{}]"), let(cut(text), lambda t: F.transform(errors, lambda e: made(t, e))))


def semicolons(text: Column, rule: str = "unbalanced_brackets_body") -> Column:
    """The first ; of each round bracket that is never closed."""
    signs = F.filter(F.transform(F.split(text, "", -1), lambda c, i: F.struct(i.alias("pos"), c.alias("c"))), lambda x: x["c"].isin("(", ")", ";"))

    def step(stacks: dict[str, Stack], x: Column) -> list:
        """The stack holds the place of each open bracket's first ; and -1 before it."""
        s, c = stacks["open"], x["c"]
        return [(c == "(", {"open": s.pushed(F.lit(-1))}), ((c == ")") & s.top().isNotNull(), {"open": s.popped()}), ((c == ";") & (s.top() == -1), {"open": s.replaced(x["pos"])})]

    left = F.filter(stacks_after(signs, ["open"], step)["open"], lambda at: at >= 0)
    made = lambda t, at: finding(
        rule, BRACKETS, CHECK, 0.75, window(t, at, 50), "[proveriti da li „;“ treba da bude „)“]", "Tačka-zarez unutar nezatvorene zagrade.", 0, 1, at)
    return F.when(text.contains("(") & text.contains(";"), let(cut(text), lambda t: F.transform(left, lambda at: made(t, at)))).otherwise(F.lit(None).cast(FINDING))


# ---- rules over a document

PLACE = ["doc_id", "ord", "section", "paragraph_id", "is_direct_quote"]
#: Levels of headings that bibliographies tell apart: one without a level counts as the first, a deeper one as the last.
LEVELS = range(1, 10)


def direct_quote(text: Column, style: Column, all_italic: Column) -> Column:
    """Confidence that a paragraph quotes: typographic quotes, guillemets, italics, a leading dash, a
    quotation style, Greek throughout; null where it doesn't."""
    t = trimmed(text)
    named = F.coalesce(style, F.lit("")).rlike("(?iu)quote|citat|blockquote")
    return (
        F.when(t.rlike(r"^\x{201E}[\s\S]*\x{201C}\z"), 0.95).when(t.rlike(r"^\x{00AB}[\s\S]*\x{00BB}\z"), 0.90)
        .when(F.coalesce(all_italic, F.lit(False)) & (F.length(t) > 20) & (named | (F.length(t) > 100)), 0.80).when(t.rlike(f"^[\\x{{2014}}\\x{{2015}}]{WS}"), 0.80)
        .when(named, 0.90).when(t.rlike(r"^[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}\s,.;\x{00B7}'\x{0022}]+\z"), 0.85)
    )


def in_context(rows: DataFrame) -> DataFrame:
    """Adds what the rules need of the rest of a document, all from one shuffle by doc_id:

    num, before: number of a list item, and of the item just before it; next_type, next_level;
    first_heading: place of the document's first heading; balanced: the document has ten or more brackets of
    a kind and opens and closes differ by two at most; straight, opened, closed: quotes of the document, on its
    first element; earlier: id (place, where there are no ids) of the element that a long paragraph repeats;
    in_bibliography: a paragraph between a bibliography heading and the next heading of its level or a
    higher one; bibliography: place of the first bibliography heading."""
    w, doc = in_order(), Window.partitionBy("doc_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text, head = F.col("text"), F.col("type") == "heading"
    par, t = F.col("type") == "paragraph", trimmed(F.col("text"))
    level = F.least(F.coalesce("level", F.lit(1)), F.lit(LEVELS[-1]))
    item = F.regexp_extract("text", f"^{WS}*(\\d+)[.)]{WS}", 1)
    rows = rows.withColumns({
        "num": F.when(item != "", item.try_cast("long")), "_title": head & t.rlike(f"(?iu)^({BIBLIOGRAPHY_TITLES})\\z"),
        "_norm": F.when(par & (F.length(t) >= 50), F.md5(collapsed(t))),
    })
    signs = {"_o0": "(", "_c0": ")", "_o1": "[", "_c1": "]", "_o2": "{", "_c2": "}", "_s": '"', "_lo": "„", "_hi": "“"}
    rows = rows.withColumns({k: F.sum(sign_count(text, c)).over(doc) for k, c in signs.items()})
    many = lambda k: (F.col(f"_o{k}") + F.col(f"_c{k}") >= 10) & (F.abs(F.col(f"_o{k}") - F.col(f"_c{k}")) <= 2)
    # a bibliography heading of a level is open while it is the last heading of its level or a higher one
    last = lambda c: F.max(F.when(c, F.col("ord"))).over(so_far)
    inside = reduce(lambda a, b: a | b, [F.coalesce(last(F.col("_title") & (level == k)) == last(head & (level <= k)), F.lit(False)) for k in LEVELS])
    mine = F.col("id") if "id" in rows.columns else F.col("ord").cast("string")
    same = Window.partitionBy("doc_id", "_norm").orderBy("ord")
    first = F.row_number().over(w) == 1
    rows = rows.withColumns({
        "before": F.lag("num").over(w), "next_type": F.lead("type").over(w), "next_level": F.lead("level").over(w),
        "first_heading": F.min(F.when(head, F.col("ord"))).over(doc),
        "balanced": F.struct(*[many(k).alias(f"b{k}") for k in range(3)]),
        **{k: F.when(first, F.col(c)) for k, c in (("straight", "_s"), ("opened", "_lo"), ("closed", "_hi"))},
        "in_bibliography": par & inside, "bibliography": F.min(F.when(F.col("_title"), F.col("ord"))).over(doc),
        "earlier": F.when(F.col("_norm").isNotNull() & (F.row_number().over(same) > 1), F.first(mine).over(same)),
    })
    return rows.drop("_title", "_norm", *signs)


def place_of(rows: DataFrame) -> list[Column]:
    """Columns PLACE of elements."""
    text, head = F.col("text"), F.col("type") == "heading"
    section = F.when(head, F.when(text != "", text).otherwise("(bez naslova)")).otherwise(F.col("section"))
    quote = ~head & direct_quote(text, F.col("style") if "style" in rows.columns else F.lit("Normal"), F.col("all_italic") if "all_italic" in rows.columns else F.lit(False)).isNotNull()
    return [F.col("doc_id"), F.col("ord"), section.alias("section"), F.col("id").alias("paragraph_id"), quote.alias("is_direct_quote")]


def quote_totals(rows: DataFrame) -> DataFrame:
    return in_context(rows).where("straight is not null").select("doc_id", "straight", "opened", "closed")


def quotes() -> Column:
    """On a document's first element: one finding for straight quotes, one for typographic ones that don't pair."""
    n, opened, closed = (F.col(c).cast("string") for c in ("straight", "opened", "closed"))
    straight = finding(
        "quotes_body", QUOTES, MUST, 0.95, quoted("[", n, " ravnih navodnika u dokumentu]"), "[zameniti tipografskim: „...“]",
        quoted("Ukupno ", n, " ravnih navodnika. Standard: „...“."), WHOLE_DOCUMENT, fix=True, whole=True)
    unpaired = finding(
        "unmatched_quotes_body", QUOTES, MUST, 0.88, quoted("[", opened, "× „ vs ", closed, "× “ u celom dokumentu]"),
        "[upariti navodnike]", "Neupareni tipografski navodnici kroz ceo dokument (moguć višepasusni citat).", WHOLE_DOCUMENT, 1)
    return F.array_compact(F.array(F.when(F.col("straight") > 0, straight), F.when(F.col("opened") != F.col("closed"), unpaired)))


#: The check whose findings are about the document, not about the element that carries them.
WHOLE_DOCUMENT = 1
TOC_LINE = f"^(.+?)(?:\\.{{3,}}|\\t){WS}*\\d+{WS}*\\z"


def toc_entry() -> Column:
    """Trimmed title of an entry of a table of contents, else null."""
    return F.when((F.col("type") == "paragraph") & F.col("text").rlike(TOC_LINE), trimmed(F.regexp_extract("text", TOC_LINE, 1)))


def heading_title() -> Column:
    title = trimmed(F.col("text"))
    return F.when((F.col("type") == "heading") & (title != ""), title)


def toc_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with doc_id, ord, entry, title (see toc_entry and heading_title). Entries with whether a heading
    equals them and the first one near them; headings of documents with entries, with whether an entry
    matches. Equal titles meet by an equi-join; near ones, three edits apart at most, differ in length by three
    at most, so that documents and lengths are the key of the other."""
    entries = rows.where("entry is not null").withColumn("key", collapsed(F.col("entry")))
    heads = rows.where("title is not null").withColumn("key", collapsed(F.col("title")))
    band = lambda c: F.explode(F.sequence(F.length(c) - 3, F.length(c) + 3))

    def met(asked: DataFrame, asked_key: str, other: DataFrame, other_name: str) -> DataFrame:
        """asked rows with same (an equal key in the document) and near (text of the first other row near it)."""
        some = other.groupBy("doc_id", "key", F.col(other_name).alias("o_name")).agg(F.min("ord").alias("o_ord"))
        keys = asked.select("doc_id", "key").distinct()
        same = some.select("doc_id", "key").distinct().withColumn("same", F.lit(True))
        low = some.groupBy("doc_id", F.lower("o_name").alias("o_low")).agg(F.min_by(F.struct("o_ord", "o_name"), "o_ord").alias("o"))
        low = low.withColumn("len", F.length("o_low"))
        near = keys.select("doc_id", "key", band(F.col("key")).alias("len")).join(low, ["doc_id", "len"]).where(F.levenshtein("o_low", "key", 3) >= 0)
        near = near.groupBy("doc_id", "key").agg(F.min("o").alias("o"))
        x = asked.join(same, ["doc_id", "key"], "left").join(near, ["doc_id", "key"], "left")
        return x.withColumns({"same": F.coalesce("same", F.lit(False)), "near": F.col("o.o_name")}).drop("o", "key")

    left = met(entries, "entry", heads, "title")
    some = heads.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")
    right = met(some, "title", entries, "entry").withColumn("met", F.col("same") | F.col("near").isNotNull())
    return left, right


def toc(rows: DataFrame) -> DataFrame:
    """rows of PLACE, entry and title -> findings."""
    left, right = toc_pairs(rows)
    close = F.col("near").isNotNull()
    original = quoted("TOC: „", F.col("entry"), "“")
    made = F.when(close, finding("toc_mismatch", TOC, MUST, 0.88, original, quoted("Uskladiti: „", F.col("near"), "“"), "Razlika TOC i naslova.", 7)).otherwise(
        finding("toc_mismatch", TOC, CHECK, 0.70, original, "[proveriti]", "TOC stavka bez odgovarajućeg naslova.", 7))
    absent = finding("toc_mismatch", TOC, CHECK, 0.70, quoted("Naslov: „", F.col("title"), "“"), "[dodati u sadržaj]", "Naslov postoji u dokumentu ali nije u sadržaju.", 7, 1)
    # a heading's text is shorter than this original, so the original can't stand in it
    return flat(left.where("not same"), made, True).unionByName(flat(right.where("not met"), absent, False))


def flat(rows: DataFrame, made: Column, stands: bool) -> DataFrame:
    return rows.withColumn("f", made).select(*PLACE, "f.*", F.lit(stands).alias("stands"))


def numbering() -> Column:
    """A list item that doesn't follow the one just before it; items that begin anew at 1 do."""
    num, before = F.col("num").cast("string"), F.col("before").cast("string")
    made = finding(
        "numbering_skip", NUMBERING, MUST, 0.85, quoted("Stavka ", num, " (prethodno: ", before, ")"), quoted("Očekivano: ", (F.col("before") + 1).cast("string")),
        quoted("Numeracija preskače sa ", before, " na ", num, "."), 8)
    return F.when(skips(), F.array(made))


def list_numbering() -> Column:
    """An item of a DOCX list whose number isn't one more than that of the item before it in its list. Reads
    number, label, list_before (struct of both for the item before) and num_pattern."""
    now, before = F.col("number"), F.col("list_before")
    expected = (before["number"] + 1).cast("string")
    shown = lambda label, n: F.coalesce(label, n.cast("string"))
    made = finding(
        "numbering_skip", NUMBERING, MUST, 0.92, quoted("Stavka ", shown(F.col("label"), now), " (prethodno: ", shown(before["label"], before["number"]), ")"),
        quoted("Očekivano: ", F.regexp_replace(F.coalesce("num_pattern", F.lit("%1.")), F.lit(r"^([^%]*)%\d"), F.concat(F.lit("$1"), expected))),
        quoted("Numeracija preskače sa ", before["number"].cast("string"), " na ", now.cast("string"), "."), 8)
    return F.when(before["number"].isNotNull() & (now != before["number"] + 1), F.array(made))


def skips() -> Column:
    return F.col("before").isNotNull() & F.col("num").isNotNull() & (F.col("num") != 1) & (F.col("num") != F.col("before") + 1)


def bibliography_entry() -> Column:
    """Whether an element is an entry of a bibliography."""
    return F.col("in_bibliography") & (F.length(trimmed(F.col("text"))) > 10)


def bibliography_lacks(text: Column) -> tuple[Column, Column]:
    """(no year, no publisher) of an entry that isn't ancient, electronic or religious."""
    word = lambda p: text.rlike(f"(?iu){EDGE_LEFT}({p}){EDGE_RIGHT}")
    modern = ~word(ANCIENT) & ~text.rlike("https?://") & ~word(RELIGIOUS)
    year = text.rlike(f"{EDGE_LEFT}(1[5-9]\\d{{2}}|20\\d{{2}}){EDGE_RIGHT}")
    house = text.rlike(f":{WS}*[A-Z\\x{{0400}}-\\x{{04FF}}]") | text.rlike("(?iu)University|Press|Verlag|izdava") | text.rlike(r"[\x{201E}\x{0022}\x{201C}\x{00AB}\x{00BB}]") | word(PERIODICALS)
    return modern & ~year, modern & ~house


def bibliography() -> Column:
    """Entries without a year or a publisher."""
    text = trimmed(F.col("text"))
    no_year, no_house = bibliography_lacks(text)
    snip = F.concat(F.substring(text, 1, 60), F.when(F.length(text) > 60, "...").otherwise(""))
    year = finding("bibliography_missing_year", BIBLIOGRAPHY, CHECK, 0.75, snip, "[dodati godinu]", "Bez godine izdanja.", 9, source=True)
    house = finding("bibliography_missing_publisher", BIBLIOGRAPHY, CHECK, 0.60, snip, "[proveriti izdavača]", "Moguć nedostatak izdavača.", 9, 1, source=True)
    return F.when(bibliography_entry(), F.array_compact(F.array(F.when(no_year, year), F.when(no_house, house))))


def cited_names() -> Column:
    """Surnames cited with a year, in elements before the first bibliography heading."""
    names = F.concat(
        F.regexp_extract_all("text", F.lit(f"\\((\\p{{Lu}}\\p{{Ll}}{{2,}}),?{WS}*\\d{{4}}\\)"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(f"(\\p{{Lu}}\\p{{Ll}}{{2,}}){WS}*\\(\\d{{4}}\\)"), F.lit(1)),
    )
    return F.when(F.col("ord") < F.col("bibliography"), F.filter(names, lambda n: ~n.isin(NOT_AUTHORS)))


def cited(rows: DataFrame) -> DataFrame:
    """rows of PLACE, bibliography, cited (see cited_names) and entry_text (text of bibliography entries) ->
    a finding at the first bibliography heading for each author that no entry names."""
    entries = rows.where("entry_text is not null").select("doc_id", "entry_text")
    some = rows.where("cited is not null").select("doc_id", F.col("bibliography").alias("ord"), F.explode("cited").alias("author")).distinct()
    some = some.join(entries.select("doc_id").distinct(), "doc_id", "left_semi")
    lost = some.alias("c").join(entries.alias("l"), F.expr("c.doc_id = l.doc_id and contains(l.entry_text, c.author)"), "left_anti")
    heads = rows.where("ord = bibliography").select(*PLACE).join(lost, ["doc_id", "ord"])
    made = finding("bibliography_cross_reference", BIBLIOGRAPHY, CHECK, 0.70, quoted("Citiran: „", F.col("author"), "“"), "[dodati u bibliografiju]", quoted(
        "„", F.col("author"), "“ citiran ali nije u bibliografiji."), 9, 2, source=True)
    return flat(heads, made, True)


def repetition() -> Column:
    made = finding("repeated_paragraph", REPETITION, MUST, 0.98, F.concat(F.substring("text", 1, 80), F.lit("...")), "[ukloniti]", quoted("Ponovljen pasus (", F.col("earlier"), ")."), 12)
    return F.when(F.col("earlier").isNotNull(), F.array(made))


def body_for_capitals() -> Column:
    t = trimmed(F.col("text"))
    shout = (t == F.upper(t)) & (t != F.lower(t))
    return (F.col("type") == "paragraph") & (F.col("first_heading").isNull() | (F.col("ord") >= F.col("first_heading"))) & ~F.col("text").rlike(r"\.{3,}") & ~shout


def capital_words(text: Column | None = None) -> Column:
    """array<struct<nth, word>>: words all in capitals that are neither acronyms nor Roman numerals, of
    paragraphs from the first heading on; of headings and tables, all words in capitals."""
    text = F.col("text") if text is None else text
    head = F.col("type").isin("heading", "table")
    words = F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= 3) & (w == F.upper(w)) & (head | (w != F.lower(w))))
    numbered_words = F.transform(words, lambda w, i: F.struct(i.alias("nth"), w.alias("word")))
    rare = F.filter(numbered_words, lambda x: head | (~x["word"].isin(ACRONYMS) & ~x["word"].rlike(r"^[IVXLCDM]+\z")))
    return F.when((head | body_for_capitals()) & text.rlike(r"\p{Lu}"), rare)


def unlisted_capitals(rows: DataFrame) -> DataFrame:
    """rows with doc_id, type and capitals (see capital_words) -> a row for each word of a paragraph that no
    heading or table of the document has in capitals."""
    titles = rows.where("type in ('heading', 'table')").select("doc_id", F.explode("capitals.word").alias("word")).distinct()
    found = rows.where("type not in ('heading', 'table')").select("*", F.explode("capitals").alias("x")).select("*", "x.nth", "x.word").drop("x", "capitals")
    return found.join(titles, ["doc_id", "word"], "left_anti")


def capitals(rows: DataFrame) -> DataFrame:
    w = F.col("word")
    made = finding("all_caps_body", CAPITALS, SHOULD, 0.70, w, "[normalizovati ako nije skraćenica]", quoted("„", w, "“ ALL-CAPS u telu teksta."), 13, 0, F.col("nth"))
    return flat(unlisted_capitals(rows), made, True)


def headings() -> Column:
    """Blank headings, and headings that one of the same or a higher level follows at once."""
    head, text = F.col("type") == "heading", F.col("text")
    blank = finding("empty_heading", STRUCTURE, MUST, 0.99, quoted("[Prazan naslov nivoa ", F.col("level").cast("string"), "]"), "[dodati tekst]", "Naslov bez sadržaja.", 14)
    bare = (F.col("next_type") == "heading") & (F.coalesce("next_level", F.lit(1)) <= F.coalesce("level", F.lit(1)))
    made = finding("empty_heading", STRUCTURE, SHOULD, 0.75, F.when(text == "", "[prazan]").otherwise(text), "[dodati sadržaj ispod]", "Naslov bez sadržaja pre naslova istog/višeg nivoa.", 14, 1)
    return F.when(head, F.array_compact(F.array(F.when(trimmed(text) == "", blank), F.when(bare, made))))


#: Rules that look at one text alone, by option.
LOCAL = {
    "brackets": semicolons, "markdown": markdown_left, "spacing": spacing, "scriptMix": script_mix, "greek": greek, "duplicates": duplicate_words, "urls": urls,
}
#: Rules over an element in its context, by option.
IN_CONTEXT = {
    "brackets": lambda: brackets(F.col("text"), F.col("balanced")), "quotes": quotes, "numbering": numbering, "bibliography": bibliography,
    "repetition": repetition, "emptyHeadings": headings,
}
#: Rules that compare elements of a document, by option; they read the narrow columns of marked().
ACROSS = {"toc": toc, "bibliography": cited, "capsWords": capitals}

# Heads of originals and of ids that need not stand in the text.
EXEMPT = ("[", "TOC:", "Stavka", "Lista", "Izvor", "Citiran")


def local_columns(options: set[str], kind: str = "txt") -> list[Column]:
    some = F.col("text") != ""
    return [F.when(some, f(F.col("text"))) for k, f in LOCAL.items() if k in options and not (k == "markdown" and kind == "markdown")]


def merged(columns: list[Column]) -> Column:
    none = F.expr(f"cast(array() as {FINDING})")
    return F.concat(*[F.coalesce(c, none) for c in columns]) if columns else none


def stands_in(text: Column, f: Column, ready: Column) -> Column:
    """A finding that holds for the document or says what isn't there, or whose original stands in the text: mostly
    about its match, which is looked at first."""
    original = f["original"]
    free = f["global_pattern"] | (f["check_ord"] == WHOLE_DOCUMENT) | reduce(lambda a, b: a | b, [original.startswith(h) for h in EXEMPT])
    clean = F.regexp_replace(F.regexp_replace(original, r"^\.\.\.", ""), r"\.\.\.\z", "")
    near = piece(ready, F.greatest(F.lit(0), f["match_pos"] - 100), 256)
    return free | (text == "") | (F.length(clean) <= 3) | F.contains(near, clean) | F.contains(text, clean)


def local(rows: DataFrame, options: set[str], kind: str = "txt") -> DataFrame | None:
    """Findings of the local rules alone."""
    columns = local_columns(options, kind)
    return exploded(rows.select(*place_of(rows), "text", merged(columns).alias("found"))) if columns else None


def exploded(rows: DataFrame) -> DataFrame:
    """rows of PLACE and found -> findings; those about the document get its place."""
    whole = F.col("f.check_ord") == WHOLE_DOCUMENT
    x = rows.select(*PLACE, F.explode("found").alias("f"))
    return x.select(
        "doc_id", F.when(whole, -1).otherwise(F.col("ord")).alias("ord"), F.when(whole, "(ceo dokument)").otherwise(F.col("section")).alias("section"),
        F.when(whole, "doc-global").otherwise(F.col("paragraph_id")).alias("paragraph_id"), (F.col("is_direct_quote") & ~whole).alias("is_direct_quote"), "f.*",
    )


@dataclass(frozen=True)
class Rule:
    """A rule of a user's own, run in the same pass as the others: find gives array<finding> (see finding) of an element's
    text, looks tells which elements it looks at. It is on where its option is; area names its check."""

    option: str
    category: str
    area: str
    find: Callable[[Column], Column]
    looks: Callable[[], Column] = lambda: F.col("text") != ""


@lru_cache(maxsize=16)
def found_column(application: str, options: frozenset[str], kind: str, listed: bool, extra: tuple[Rule, ...] = ()) -> Column:
    """Findings of all rules but those of ACROSS. Its thousands of parts are put together once for an application."""
    text = F.col("text")
    columns = local_columns(set(options), kind) + [f() for k, f in IN_CONTEXT.items() if k in options]
    if "numbering" in options and listed:
        columns.append(list_numbering())
    columns += [F.when(r.looks(), r.find(text).cast(FINDING)) for r in extra if r.option in options]
    return let(cut(text), lambda t: F.transform(merged(columns), lambda f: f.withField("stands", stands_in(text, f, t))))


def marked(rows: DataFrame, options: set[str], kind: str = "txt", extra: tuple[Rule, ...] = ()) -> DataFrame:
    """Elements -> PLACE, type, found (findings of all rules but those of ACROSS, and whether they stand in the
    text) and the narrow columns that ACROSS and the counts of checks read. This is the one pass over texts."""
    text = F.col("text")
    found = found_column(rows.sparkSession.sparkContext.applicationId, frozenset(options), kind, "list_before" in rows.columns, extra)
    on = lambda k, c: c if k in options else F.lit(None)
    return in_context(rows).select(
        *place_of(rows), "type", found.alias("found"), on("toc", toc_entry()).cast("string").alias("entry"), on("toc", heading_title()).cast("string").alias("title"),
        F.when(bibliography_entry(), text).alias("entry_text"), on("bibliography", cited_names()).cast("array<string>").alias("cited"), "bibliography",
        on("capsWords", capital_words(F.col("table_text") if "table_text" in rows.columns else None)).cast("array<struct<nth:int,word:string>>").alias("capitals"), seen(kind, extra).alias("seen"),
    )


def seen(kind: str = "txt", extra: tuple[Rule, ...] = ()) -> Column:
    """Bits of the checks, in the order of review.CHECKS and then of extra, that look at an element."""
    text, par, t = F.col("text"), F.col("type") == "paragraph", trimmed(F.col("text"))
    some, no = text != "", F.lit(False)
    looks = [
        t != "", some, no if kind == "markdown" else some, some, some, some, some, par & text.rlike(TOC_LINE), text.rlike(f"^{WS}*(\\d+)[.)]{WS}"),
        bibliography_entry(), some, par & (F.length(t) >= 50), body_for_capitals() & some, F.col("type") == "heading",
    ]
    looks += [r.looks() for r in extra]
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << i).cast("long")).otherwise(0) for i, c in enumerate(looks)]).cast("long")


def candidates(rows: DataFrame, options: set[str]) -> DataFrame:
    """Findings of all rules that are on, from marked elements; rules that are off are not in the plan."""
    parts = [exploded(rows), *[f(rows) for k, f in ACROSS.items() if k in options]]
    return reduce(DataFrame.unionByName, parts)
