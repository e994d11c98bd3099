"""Symbols of source files: a lexer, bracket levels, statements, and declarations by their outline.

Files are dealt by their paths, then become token rows by one pattern a language, which knows comments, strings, raw strings,
regex literals and preprocessor lines, so nothing inside those is ever taken for code. Levels are
running sums over brackets, made on Arrow batches of whole files where the tokens are cut. The tokens of one level between two statement ends are a statement; what
its brackets enclose lies a level deeper, so the outline of a statement, ``export class A { }``, is short
whatever its body holds, and tells its kind and name. A bracket leads to the statements inside it, and
containers hand their names down to them, round by round.

Files are bounded (``files.MAX_BYTES``), so what a task holds of one file is too."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settle

SIGNATURE_CHARS = 200
TASKS_A_CORE = 4
TS, PHP, RUST, CXX, LUA = ("typescript", "tsx", "javascript"), ("php",), ("rust",), ("c", "cpp"), ("lua",)

# --- lexers: each match is white space and one token, and matches cover the file

_BLOCK, _LINE = r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*+"


def _quoted(q: str, escape: str = r"\\") -> str:
    return rf"{q}[^{q}{escape}]*+(?:{escape}[\s\S][^{q}{escape}]*+){{0,2000}}+{q}"


_WORD = r"[\p{L}_$][\p{L}\p{N}_$]*+"
_REST = r"\d[\w.]*+|=>|\?->|->|::|\.\.\.|&&|\|\||[-+*/%&|^!=<>]=++|[\s\S]"
_REGEX = r"(?=/)(?<=[=(,:;!&|?{}\[+*%~^<>-]\s{0,9}|\breturn\s{1,9}|\A)/(?![*/])[^/\\\[\n]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+){0,200}+\])[^/\\\[\n]*+){0,500}+/[a-z]*+"
_ATTRIBUTE = r"#!?\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\]"
LEXERS = {
    TS: rf"\s*+(?:{_BLOCK}|{_LINE}|{_quoted('"')}|{_quoted("'")}|{_quoted('`')}|{_REGEX}|#?{_WORD}|{_REST})",
    PHP: rf"\s*+(?:\A[\s\S]*?(?:<\?(?:php\b|=)|\z)|\?>[\s\S]*?(?:<\?(?:php\b|=)|\z)|{_BLOCK}|{_LINE}|{_ATTRIBUTE}|#[^\n]*+|<<<[ ]*(['\"]?)(\w+)\1[\s\S]*?\n\s*\2\b|{_quoted('"')}|{_quoted("'")}|{_WORD}|{_REST})",
    RUST: rf"\s*+(?:/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*[\s\S]*?\*/)*+\*/|{_LINE}|{_ATTRIBUTE}|b?r(#*+)\"[\s\S]*?\"\1|{_quoted('"')}|b?'(?:\\[^\n']*+\\?'|[^\\\n]')|'\w++|{_WORD}|{_REST})".replace(r"\\[^\n']*+\\?'", r"\\(?:'|[^\n']++)'"),
    CXX: rf"\s*+(?:{_BLOCK}|{_LINE}|#(?:[^\\\n/]|\\[\s\S]|/(?![/*]))*+|R\"([^(\s]*+)\([\s\S]*?\)\1\"|{_quoted('"')}|{_quoted("'")}|{_WORD}|{_REST})",
    LUA: rf"\s*+(?:--\[(=*+)\[[\s\S]*?(?:\]\1\]|\z)|--[^\n]*+|\[(=*+)\[[\s\S]*?\]\2\]|{_quoted('"')}|{_quoted("'")}|function\b[ \t]*+[\w.:]*+|{_WORD}|\.\.\.|{_REST})",
}
_COMMENT = {TS: r"^/[/*]", PHP: r"^(/[/*]|#)", RUST: r"^(/[/*]|#!?\[)", CXX: r"^/[/*]", LUA: r"^--"}


def _by_language(table: dict, make, other: Column) -> Column:
    out = None
    for langs, x in table.items():
        out = F.when(F.col("lang").isin(*langs), make(x)) if out is None else out.when(F.col("lang").isin(*langs), make(x))
    return out.otherwise(other)


def tokens(files: DataFrame) -> DataFrame:
    """path, lang, pos, raw, text of every token of ``files`` (path, lang, content), the tokens of a file one after another:
    files are dealt by their paths before they are cut, so a token is never shuffled."""
    lexed = _by_language(LEXERS, lambda x: F.regexp_extract_all("content", F.lit(x), F.lit(0)), F.array().cast("array<string>"))
    tasks = TASKS_A_CORE * files.sparkSession.sparkContext.defaultParallelism  # by number, as files are small for what they cost
    rows = files.repartition(tasks, "path").select("path", "lang", F.posexplode(lexed).alias("pos", "raw"))
    return rows.withColumn("text", F.ltrim("raw", F.lit(" \t\n\x0b\f\r"))).where("text <> ''")


def _first_line(comment: Column) -> Column:
    """The first line of a comment that says something, without its marks."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(comment), r"^/\*+|\*+/$|^-{2,}\[=*\[|\]=*\]$", ""), r"\r", "")
    marks = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(\*+\s?|/{2,}\s?|-{2,}\s?|#+\s?)", ""), r"^!\s?", "")))
    return F.get(F.filter(marks, lambda x: x != ""), 0)


# --- statements

_GOES_ON = (";", ",", ")", "]", ".", "?", ":", "?->", "->", "::", "=", "==", "===", "&&", "||", "+", "-", "*", "/", "|", "&", "else", "elseif", "catch", "finally", "while", "from", "as", "satisfies", "instanceof", "in", "of")
_BINARY = r"^(?:in|of|instanceof|extends|implements|from|as|satisfies|else|catch|finally)$"
_LUA_OPEN, _LUA_SHUT = r"^(?:function\b.*|do|if|repeat)$", r"^(?:end|until)$"
_LUA_INNER = ("and", "or", "not", "then", "do", "else", "elseif", "until", "end", "in")
_LUA_NEEDS = ("and", "or", "not", "then", "do", "else", "elseif", "until", "in", "local", "return", "repeat", "if", "while", "for", "goto", "function")


def _marks() -> dict[str, Column]:
    """What a token is by itself: everything that takes a pattern, so that running sums do the rest."""
    text, lang = F.col("text"), lambda *x: F.col("lang").isin(*[y for z in x for y in z])
    lua, binary = lang(LUA), text.rlike(_BINARY)
    skipped = _by_language(_COMMENT, lambda x: text.rlike(x), F.lit(False)) | (lang(PHP) & text.rlike(r"<\?(php|=)?$"))
    return {
        "skipped": skipped,
        "comment": skipped & ~text.rlike(r"^#!?\[|<\?(php|=)?$"),
        "opens": text.isin("(", "[", "{") | lua & text.rlike(_LUA_OPEN),
        "shuts": text.isin(")", "]", "}") | lua & text.rlike(_LUA_SHUT),
        "brace": text == "{",
        "shut": text == "}",
        "goes_on": text.isin(*_GOES_ON),
        "word": text.rlike(r"^[\p{L}_]"),
        "semicolon": text == ";",
        "colon": text == ":",
        "hash": lang(CXX) & text.startswith("#"),
        "access": text.isin("public", "private", "protected"),
        "tail": lang(TS) & text.rlike(r"[\p{L}\p{N}_$\"'`)\]}>/]$") & ~binary,
        "head": lang(TS) & text.rlike(r"^[\p{L}_$@\"'#]") & ~binary,
        "lua_tail": lua & text.rlike(r"(?:[\p{L}\p{N}_\"')\]}]|\.\.\.)$") & ~text.isin(*_LUA_NEEDS) & ~text.rlike(r"^function\b"),
        "lua_head": ~text.isin(*_LUA_INNER),
    }


def statements(token: DataFrame) -> DataFrame:
    """path, lang, level, opener (the position of the bracket around it, -1 at the top), stmt, outline, and of
    each its first position, lines, doc, start and, if it has a body, the character where that begins. Comments and
    attributes are skipped; ``doc`` is the comment above: the nearest one or, where a grammar has one comment a line, the
    first of its run. The tokens of a file come one after another (``tokens``), and a task holds those of one batch and one file."""
    marks = _marks()
    families = F.lit(-1)
    for k, langs in enumerate((TS, PHP, RUST, CXX, LUA)):
        families = F.when(F.col("lang").isin(*langs), k).otherwise(families)
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(marks.values())), F.lit(0))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    short = F.when(F.length("text") <= 200, F.col("text")).otherwise(F.lit('""'))
    rows = token.withColumn("bits", bits).select(
        "path", "lang", "pos", families.alias("family"), "bits", short.alias("short"), F.when(F.col("bits").bitwiseAND(2) != 0, F.col("text")).alias("said"),
        lines("raw").alias("raw_lines"), lines("text").alias("lines"), F.length("raw").alias("raw_chars"), F.length("text").alias("chars"),
    )
    bit = {name: k for k, name in enumerate(marks)}

    def cut(t):
        """The statements of whole files."""
        col = {c: t[c].to_numpy() for c in ("pos", "family", "bits", "raw_lines", "lines", "raw_chars", "chars")}
        n, pos, family = t.num_rows, col["pos"].astype(np.int64), col["family"]
        path = t["path"].combine_chunks()
        first = np.concatenate([[True], pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)])
        file = np.cumsum(first) - 1
        begins = np.flatnonzero(first)
        place = np.arange(n)
        begin = begins[file]
        is_ = {name: (col["bits"] >> k) & 1 == 1 for name, k in bit.items()}

        def before(x):
            """Running sums within each file, without the row itself."""
            run = np.cumsum(x) - x
            return run - run[begin]

        def last(flag):
            """The place of the latest flagged row before each row of its file, or -1."""
            run = np.concatenate([[-1], np.maximum.accumulate(np.where(flag, place, -1))[:-1]])
            return np.where(run >= begin, run, -1)

        raw_lines = col["raw_lines"].astype(np.int64)
        above = 1 + before(raw_lines)
        start_line, end_line = above + raw_lines - col["lines"], above + raw_lines
        raw_chars = col["raw_chars"].astype(np.int64)
        at = before(raw_chars) + raw_chars - col["chars"]
        lag = lambda x: np.concatenate([[False], x[:-1]]) & ~first
        after, near = lag(is_["skipped"]), last(is_["comment"])
        said = np.where(family == 0, np.where(lag(is_["comment"]), near, -1), np.where(after, np.where(family == 1, near, last(is_["comment"] & ~after)), -1))

        kept = np.flatnonzero(~is_["skipped"])
        if not len(kept):
            return None
        is_ = {name: x[kept] for name, x in is_.items()}
        file, pos, family, said, at, start_line, end_line = (x[kept] for x in (file, pos, family, said, at, start_line, end_line))
        till = at + col["chars"][kept]
        same = np.concatenate([file[1:] == file[:-1], [False]])  # a token of the same file follows
        lead = lambda x: np.concatenate([x[1:], [False]]) & same
        opens, shuts = is_["opens"].astype(np.int64), is_["shuts"].astype(np.int64)
        run = np.cumsum(opens - shuts) - (opens - shuts)
        heads = np.flatnonzero(np.concatenate([[True], ~same[:-1]]))
        level = run - run[heads[np.cumsum(np.concatenate([[True], ~same[:-1]])) - 1]] - shuts
        below = np.concatenate([start_line[1:] > end_line[:-1], [False]]) & same
        brace, word = is_["shut"] & same & ~lead(is_["goes_on"]), lead(is_["word"])
        previous = np.concatenate([[False], (is_["access"] & same)[:-1]])
        ends = is_["semicolon"] | brace
        ends = np.where(family == 0, is_["semicolon"] | brace & (below | word) | below & is_["tail"] & lead(is_["head"]), ends)
        cxx = is_["semicolon"] | is_["hash"] | lead(is_["hash"]) | brace & (below | ~word) | is_["access"] & lead(is_["colon"]) | is_["colon"] & previous
        ends = np.where(family == 3, cxx, ends)
        ends = np.where(family == 4, is_["lua_tail"] & word & lead(is_["lua_head"]), ends)

        # rows by file and level; a bracket is also a mark on the level that it opens
        marks = np.flatnonzero(is_["opens"])
        row = np.concatenate([np.arange(len(kept)), marks])
        mark = np.arange(len(row)) >= len(kept)
        depth = level[row] + mark
        order = np.lexsort((row, depth, file[row]))
        row, mark, depth = row[order], mark[order], depth[order]
        new = np.concatenate([[True], (file[row[1:]] != file[row[:-1]]) | (depth[1:] != depth[:-1])])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        latest = np.maximum.accumulate(np.where(mark, np.arange(len(row)), -1))
        opener = np.where(latest >= start, pos[row[latest]], -1)
        ended = ends[row] & ~mark
        stmt = np.cumsum(ended) - ended
        stmt = stmt - stmt[start]
        row, depth, opener, stmt = (x[~mark] for x in (row, depth, opener, stmt))
        change = (file[row[1:]] != file[row[:-1]]) | (depth[1:] != depth[:-1]) | (opener[1:] != opener[:-1]) | (stmt[1:] != stmt[:-1])
        one = np.flatnonzero(np.concatenate([[True], change]))  # the first row of each statement
        stop = np.concatenate([one[1:], [len(row)]])
        head, tail = row[one], row[stop - 1]
        words = t["short"].combine_chunks().take(pa.array(kept[row]))
        outline = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([one, [len(row)]]), pa.int32()), words), " ")
        body = np.maximum.reduceat(np.where(is_["brace"][row], at[row], -1), one)
        held = is_["opens"][row]
        brackets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)[stop - 1]]), pa.int32()), pa.array(pos[row][held], pa.int64()))
        whole = pa.array(kept[head])
        told = t["said"].combine_chunks().take(pa.array(said[head], mask=said[head] < 0))
        return pa.RecordBatch.from_arrays(
            [path.take(whole), t["lang"].combine_chunks().take(whole), pa.array(depth[one], pa.int64()), pa.array(opener[one], pa.int64()), pa.array(stmt[one], pa.int64()), outline, pa.array(pos[head], pa.int64()), pa.array(start_line[head], pa.int64()), pa.array(end_line[tail], pa.int64()), told, pa.array(at[head], pa.int64()), pa.array(body, pa.int64(), mask=body < 0), pa.array(till[tail], pa.int64()), brackets],
            ["path", "lang", "level", "opener", "stmt", "outline", "pos", "start_line", "end_line", "said", "at", "body", "till", "brackets"],
        )

    def run(batches):
        left = []  # batches that hold a file whose end was not seen
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0)
            same = pc.equal(path, path[batch.num_rows - 1]).to_numpy(zero_copy_only=False)
            at = 0 if same.all() else batch.num_rows - int(np.argmin(same[::-1]))
            if at == 0 and (not left or left[-1].column(0)[-1].as_py() == path[0].as_py()):
                left.append(batch)
                continue
            found = cut(pa.Table.from_batches([*left, batch.slice(0, at)]))
            left = [batch.slice(at)]
            if found is not None:
                yield found
        if left:
            found = cut(pa.Table.from_batches(left))
            if found is not None:
                yield found

    found = rows.mapInArrow(run, "path string, lang string, level long, opener long, stmt long, outline string, pos long, start_line long, end_line long, said string, at long, body long, till long, brackets array<long>")
    return found.withColumn("doc", _first_line(F.col("said"))).drop("said")


# --- declarations by outline

_ANGLE = r"<[^<>]*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>[^<>]*)*>"
_N = r"([\p{L}_$#][\p{L}\p{N}_$]*)"
_EX = r"^(?:export )?(?:default )?"
#: language: (kind, pattern whose first group is the name, kinds of containers in which it counts; None is the top).
#: The first that matches tells. A container named "" lends no name.
RULES = {
    TS: (
        ("class", _EX + r"(?:abstract )?class " + _N + r"(?= ).*\{ \}", (None,)),
        ("function", _EX + r"(?:async )?function (?:\* )?" + _N + r" .*\}$", (None,)),
        ("interface", _EX + r"interface " + _N + r" .*\}", (None,)),
        ("enum", _EX + r"(?:const )?enum " + _N + r" \{", (None,)),
        ("type", r"^(?:export )?type " + _N + r" (?:<.*> )?=", (None,)),
        ("const", r"^(?:export )?(?:const|let|var) " + _N + r"(?= |$)", (None,)),
        ("method", r"^(?:@ [\w$.]+ (?:\. [\w$]+ )*(?:\( \) )?)*(?:(?:public|private|protected|static|async|get|set|override|\*) )*(?!(?:if|for|while|switch|catch|return|function)\b)" + _N + r" (?:<.*> )?\( \)(?: :.*)? \{ \}$", ("class",)),
    ),
    PHP: (
        ("", r"^namespace (?:[\w\\ ]+ )?\{ \}()", (None,)),
        ("class", r"^(?:(?:abstract|final|readonly) )*class (\w+) .*\{ \}", (None, "")),
        ("trait", r"^trait (\w+) .*\{ \}", (None, "")),
        ("enum", r"^enum (\w+) .*\{ \}", (None, "")),
        ("interface", r"^interface (\w+) .*\{ \}", (None, "")),
        ("function", r"^function (?:& )?(\w+) \( \).*\{ \}", (None, "")),
        ("const", r"^const (\w+) =", (None, "")),
        ("method", r"^(?:(?:public|protected|private|static|abstract|final) )*function (?:& )?(\w+) \( \)", ("class", "trait", "enum")),
    ),
    RUST: tuple(
        (kind, r"^(?:pub (?:\( \) )?)?" + tail, within)
        for kind, tail, within in (
            ("function", r"(?:(?:default|const|async|unsafe|extern|\"[^\"]*\") )*fn (\w+) ", (None, "mod")),
            ("method", r"(?:(?:default|const|async|unsafe|extern|\"[^\"]*\") )*fn (\w+) ", ("trait", "impl")),
            ("struct", r"(?:struct|union) (\w+)\b", (None, "mod")),
            ("enum", r"enum (\w+) ", (None, "mod")),
            ("trait", r"(?:unsafe )?(?:auto )?trait (\w+) ", (None, "mod")),
            ("impl", r"(?:default )?(?:unsafe )?impl .*\{ \}()", (None, "mod")),
            ("const", r"(?:const|static)(?: mut)? (\w+) :", (None, "mod")),
            ("type", r"type (\w+) ", (None, "mod")),
            ("macro", r"macro_rules ! (\w+) ", (None, "mod")),
            ("mod", r"mod (\w+) \{ \}", (None, "mod")),
        )
    ),
    CXX: (
        ("", r"^(?:namespace \{ \}|extern \"[^\"]*\" \{ \})()", (None, "", "namespace")),
        ("namespace", r"^(?:inline )?namespace (\w+(?: :: \w+)*) \{ \}", (None, "", "namespace")),
        ("macro", r"^#\s*define\s+(\w+)", (None, "", "namespace")),
        ("struct", r"^typedef (?:struct|union|class) (?:\w+ )?\{ \} (?:\* )?(\w+) ;", (None, "", "namespace")),
        ("type", r"^typedef (?!.*\{).* (\w+)(?: \[ \])? ;", (None, "", "namespace")),
        ("type", r"^(?:template <.*> )?using (\w+) =", (None, "", "namespace", "class", "struct")),
        ("enum", r"^(?:typedef )?enum (?:class |struct )?(\w+) [^;]*\{ \}", (None, "", "namespace", "class", "struct")),
        ("class", r"^(?:template <.*> )?class (?:\w+ (?=(?!final\b)\w))?(\w+) (?:final )?(?::(?!:)[^{;]*)?(?:\{ \}|;)", (None, "", "namespace", "class", "struct")),
        ("struct", r"^(?:template <.*> )?(?:struct|union) (?:\w+ (?=(?!final\b)\w))?(\w+) (?:final )?(?::(?!:)[^{;]*)?(?:\{ \}|;)", (None, "", "namespace", "class", "struct")),
        ("method", r"^(?!using|typedef|return|friend)[^=(]*?((?:operator [^ ]+(?: [^ \w(]+)*)|~ \w+|\w+) \( \)[^=]*(?:= (?:0|default|delete) )?(?:;|\{ \})$", ("class", "struct")),
        ("function", r"^(?!using|typedef|return|if|for|while|switch|else|catch|#)(?:[^=(]*(?<!::) )?((?:\w+ (?:<[^(]*> )?:: )*(?:operator [^ ]+(?: [^ \w(]+)*|~ \w+|\w+)) \( \)(?!.*\( \) \( \))[^=;]*\{ \}$", (None, "", "namespace")),
        ("function", r"^(?!using|typedef|return|if|for|while|switch|else|catch|#)[^=(]*(?<!::) ((?:\w+ :: )*\w+) \( \)[^=({]* ?;$", (None, "", "namespace")),
        ("const", r"^(?!using|typedef|return|class|struct|union|enum|namespace|friend|goto|#)[^=(]*[\w>*&] (\w+) (?:\[ \] )*(?:=.*|\{ \} )?;$", (None, "", "namespace")),
    ),
    LUA: (
        ("function", r"^(?:local )?function\s+([\w.:]+) .*end$", (None,)),
        ("function", r"^(?:local )?(\w+(?: \. \w+)*) = function\b.*end$", (None,)),
        ("const", r"^(?:local )?(\w+(?: \. \w+)*)(?: < \w+ >)?(?: , \w+(?: \. \w+)*)* = (?!require\b)", (None,)),
    ),
}


def _declared(within: Column) -> Column:
    """kind and name of an outline in a container of kind ``within`` (null at the top), or null."""

    def tell(rules):
        out = F.lit(None).cast("struct<kind:string,name:string>")
        for kind, pattern, places in reversed(rules):
            place = F.lit(False)
            for p in places:
                place = place | (within.isNull() if p is None else within.eqNullSafe(F.lit(p)))
            found = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("outline", pattern, 1).alias("name"))
            out = F.when(place & F.col("outline").rlike(pattern), found).otherwise(out)
        return out

    return _by_language(RULES, tell, F.lit(None).cast("struct<kind:string,name:string>"))


def _rust_type(text: Column) -> Column:
    """The last name of a type's path, without references and parameters."""
    bare = F.regexp_replace(F.regexp_replace(text, _ANGLE, ""), r"\bwhere\b.*|'\w+|\b(?:dyn|mut)\b|[&*(){}\[\]]", " ")
    return F.regexp_extract(F.trim(bare), r"(\w+)\s*$", 1)


def _every_name(first: Column) -> Column:
    """All names that a statement of constants declares, of which the rules give the first."""
    plain = F.regexp_replace("outline", _ANGLE, "")
    more = (
        F.when(F.col("lang").isin(*TS), F.regexp_extract_all(plain, F.lit(r", ([\p{L}_$][\p{L}\p{N}_$]*)(?= [=:,;]|$)"), F.lit(1)))
        .when(F.col("lang").isin(*PHP), F.regexp_extract_all(plain, F.lit(r", (\w+)(?= =)"), F.lit(1)))
        .when(F.col("lang").isin(*CXX), F.regexp_extract_all(plain, F.lit(r"(\w+) (?:\[ \] )*(?:= [^,;]*|\{ \} )?(?=[,;])"), F.lit(1)))
        .when(F.col("lang").isin(*LUA), F.transform(F.split(F.regexp_extract(plain, r"^(?:local )?([^=]*?) =", 1), ","), lambda x: F.replace(x, F.lit(" "), F.lit(""))))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.concat(F.array(first), more))


def symbols(files: DataFrame) -> DataFrame:
    """path, kind, name, qualified, start_line, end_line, signature, doc of the declarations in ``files`` (path, lang,
    content): the module itself, what its top declares, and members of containers. Of those that share
    path, kind and qualified name the first counts. Files in other languages have none."""
    known = files.where(F.col("lang").isin(*(x for langs in LEXERS for x in langs)))
    every = settle(statements(tokens(known)))
    top = every.where("opener = -1").withColumns({"within": F.lit(None).cast("string"), "prefix": F.lit(""), "owner": F.lit("")})
    found, depth = None, 0
    while True:
        told = top.withColumn("d", F.explode(F.array(_declared(F.col("within"))))).where("d IS NOT NULL")  # told once, as no filter passes a generator
        rust, cxx, lua = F.col("lang").isin(*RUST), F.col("lang").isin(*CXX), F.col("lang").isin(*LUA)
        impl = F.regexp_replace(F.regexp_extract(F.regexp_replace("outline", "->", ""), r"\bimpl (.*) \{ \}", 1), rf"^{_ANGLE}", "")
        of, trait = _rust_type(F.regexp_replace(impl, r"^.*? for ", "")), _rust_type(F.regexp_extract(impl, r"^(.*?) for ", 1))
        name = F.when(F.col("d.kind") == "impl", of).otherwise(F.regexp_replace("d.name", r"\s", ""))
        told = told.withColumns({"kind": F.col("d.kind"), "whole": name, "trait": trait})
        told = told.withColumn("whole", F.explode(F.when(F.col("kind") == "const", _every_name(F.col("whole"))).otherwise(F.array("whole"))))
        scope = F.when(cxx, F.regexp_extract("whole", r"^(.*)::[^:]*$", 1)).when(lua, F.regexp_extract("whole", r"^(.*)[.:]\w+$", 1)).otherwise(F.lit(""))
        told = told.withColumns({"name": F.when(cxx | lua, F.regexp_extract("whole", r"([^:.]*)$", 1)).otherwise(F.col("whole")), "scope": scope})
        told = told.withColumn("owned", (cxx & (F.col("kind") == "function") | lua) & (F.col("scope") != ""))
        owned = F.col("owned")
        told = told.withColumn("kind", F.when(owned & (F.col("kind") == "function"), "method").otherwise(F.col("kind")))
        label = F.when(F.col("kind") == "impl", F.when(F.col("trait") != "", F.concat(F.lit("impl "), "trait", F.lit(" for "), "name")).otherwise(F.concat(F.lit("impl "), "name"))).when(owned, F.concat("scope", F.lit("."), "name")).otherwise(F.col("whole"))
        qualified = F.when((F.col("kind") == "method") & (F.col("owner") != ""), F.concat("owner", F.lit("."), "name")).otherwise(F.concat("prefix", label))
        told = settle(told.withColumn("qualified", qualified).withColumn("name", F.when((F.col("kind") == "namespace"), F.col("whole")).otherwise(F.col("name"))))
        part = told.where("kind <> ''").select("path", "pos", "kind", "name", "qualified", "start_line", "end_line", "at", "body", "till", "doc")
        found = part if found is None else found.unionByName(part)
        inside = F.when(F.col("kind").isin("mod", "namespace") | cxx & F.col("kind").isin("class", "struct"), F.concat("prefix", "whole", F.lit("::"))).otherwise(F.col("prefix"))
        owner = F.when(F.col("kind").isin("class", "struct", "trait", "enum"), F.col("qualified")).when(F.col("kind") == "impl", F.concat("prefix", "name")).otherwise(F.lit(""))
        held = told.where(F.col("kind").isin("", "class", "trait", "enum", "impl", "mod", "namespace", "struct")).select("path", F.explode("brackets").alias("opener"), F.col("kind").alias("within"), inside.alias("prefix"), owner.alias("owner"))
        if held.isEmpty():
            break
        depth += 1  # what a bracket holds lies one level deeper
        top = every.where((F.col("opener") >= 0) & (F.col("level") <= depth)).join(held, ["path", "opener"])
    macros = found.where("kind = 'macro'")
    guard = macros.join(every.where(F.startswith("outline", F.lit("#"))).select("path", (F.col("pos") + 1).alias("pos"), F.regexp_extract("outline", r"^#\s*ifn?def\s+(\w+)", 1).alias("guard")), ["path", "pos"])
    found = found.where("kind <> 'macro'").unionByName(macros.join(guard.where("guard = name").select("path", "pos"), ["path", "pos"], "left_anti"))
    first = found.repartition("path").groupBy("path", "kind", "qualified").agg(F.min_by(F.struct("name", "start_line", "end_line", "at", "body", "till", "doc"), "pos").alias("s"))
    stop = F.coalesce(F.when(F.col("s.body") > F.col("s.at"), F.col("s.body")), F.col("s.till"))
    source = F.substring(F.col("content"), F.col("s.at") + 1, stop - F.col("s.at"))
    clean = F.trim(F.regexp_replace(F.when(F.col("s.body").isNotNull(), source).otherwise(F.regexp_extract(source, r"^[^\n]*", 0)), r"\s+", " "))
    short = F.when(F.length(clean) > SIGNATURE_CHARS, F.concat(F.rtrim(F.substring(clean, 1, SIGNATURE_CHARS)), F.lit("…"))).otherwise(clean)
    # plain rows: whoever asks for no signature shuffles no text
    named = first.join(known.select("path", "content"), "path").select("path", "kind", "s.name", F.concat("path", F.lit(":"), "qualified").alias("qualified"), "s.start_line", "s.end_line", short.alias("signature"), "s.doc")
    whole = F.concat(F.lit("module "), "path")
    module = known.select(
        "path", F.lit("module").alias("kind"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("path").alias("qualified"), F.lit(1).cast("long").alias("start_line"),
        (1 + F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))).cast("long").alias("end_line"),
        F.when(F.length(whole) > SIGNATURE_CHARS, F.concat(F.rtrim(F.substring(whole, 1, SIGNATURE_CHARS)), F.lit("…"))).otherwise(whole).alias("signature"), F.lit(None).cast("string").alias("doc"),
    )
    return module.unionByName(named)
