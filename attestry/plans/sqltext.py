"""SQL fragments shared by the oracle statements (DuckDB dialect)."""


def norm(x: str) -> str:
    for glyph, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{glyph}', '{letters}')"
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])[-−–—][\s\p{{Z}}]+([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    return f"lower(trim(regexp_replace({x}, '[^0-9a-zA-Z]+', ' ', 'g')))"


def fold(x: str) -> str:
    return f"lower(trim(regexp_replace(strip_accents({x}), '[^0-9a-zA-Z]+', ' ', 'g')))"


def flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def six(x: str) -> str:
    return f"replace(format('{{:.5e}}', {x}::double), 'inf', 'Infinity')"


def numbers(x: str) -> str:
    plain = f"replace(translate({x}, '−–—', '---'), ',', '')"
    return rf"list_distinct(list_transform(regexp_extract_all({plain}, '(?:^|[^\d.])(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)', 1), lambda n: {six('n')}))"


def fingerprint(value_json: str, quote: str) -> str:
    return f"left(sha256('[' || coalesce({value_json}, 'null') || ', ' || to_json(coalesce({quote}, ''))::varchar || ']'), 16)"


def regex_ladder(x: str, rules) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '{p}') then '{label}'" for p, label in rules) + " end"


def contains_ladder(x: str, rules) -> str:
    return "case " + " ".join(f"when contains({x}, '{w}') then '{label}'" for w, label in rules) + " end"
