"""SQL spellings of the text functions, for the checks in DuckDB."""

from __future__ import annotations

from cellarspark.functions import words as W

ONLY_LATIN = "".join(x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if x not in W.LOOK_LATIN)
ONLY_CYRILLIC = "".join(x for x in "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" if x not in W.LOOK_CYRILLIC)


def quoted(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def normalize(c: str) -> str:
    return f"trim(translate(upper(regexp_replace(coalesce({c}, ''), '[^A-Za-zА-Яа-яЁё0-9ЂЋђћ]+', ' ', 'g')), 'ЁЂЋ01', 'ЕЬЬОI'))"


def votes(c: str, letters: str) -> str:
    return f"(length({c}) - length(translate({c}, '{letters}', '')))"


def mostly_cyrillic(c: str) -> str:
    lat, cyr, ll, lc = votes(c, ONLY_LATIN), votes(c, ONLY_CYRILLIC), votes(c, W.LOOK_LATIN), votes(c, W.LOOK_CYRILLIC)
    return f"(CASE WHEN {cyr} <> {lat} THEN {cyr} > {lat} ELSE {lc} > {ll} END)"


def fold(c: str) -> str:
    return f"(CASE WHEN {mostly_cyrillic(c)} THEN translate({c}, '{W.LOOK_LATIN}', '{W.LOOK_CYRILLIC}') ELSE {c} END)"


def tokens(c: str) -> str:
    flush = f"(CASE WHEN length(s.run) >= 4 THEN list_append(s.o, {fold('s.run')}) ELSE s.o END)"
    single = "regexp_full_match(t, '[A-ZА-Я]')"
    step = f"{{'run': CASE WHEN {single} THEN s.run || t ELSE '' END, 'o': CASE WHEN {single} THEN s.o WHEN length(t) >= 3 THEN list_append({flush}, t) ELSE {flush} END}}"
    words = f"list_transform(list_filter(string_split({normalize(c)}, ' '), lambda t: t <> ''), lambda t: {fold('t')})"
    # an end marker of two characters flushes the last run
    run = f"list_reduce(list_append({words}, '--'), lambda s, t: {step}, {{'run': '', 'o': []::VARCHAR[]}})"
    return f"list_transform(({run}).o, lambda t: CASE WHEN regexp_full_match(t, '3[A-ZА-Я]{{4,}}') THEN 'З' || substr(t, 2) ELSE t END)"


def cell(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR lower(trim({c})) = 'nan' THEN '' ELSE trim({c}) END)"


def lcs(a: str, b: str) -> str:
    step = f"list_append(acc, CASE WHEN substr({a}, i::INT, 1) = substr({b}, j::INT, 1) THEN row[j::INT] + 1 ELSE greatest(row[j::INT + 1], acc[j::INT]) END)"
    inner = f"list_reduce(range(1, length({b}) + 1), lambda acc, j: {step}, [0])"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(range(1, length({a}) + 1), lambda row, i: {inner}, list_transform(range(0, length({b}) + 1), lambda z: 0))[length({b})::INT + 1] END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * {lcs(a, b)} / (length({a}) + length({b})) END)"


def near(c: str, target: str) -> str:
    return f"(length({c}) >= 5 AND abs(length({c}) - {len(target)}) <= 1 AND {ratio(c, repr(target))} >= 0.8)"


def mapped(c: str, values: dict[str, str]) -> str:
    return "(CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END)"


def brut(c: str) -> str:
    letters = f"regexp_replace(translate(upper({c}), '{W.LOOK_CYRILLIC}', '{W.LOOK_LATIN}'), '[^A-ZА-Я]', '', 'g')"
    return f"(regexp_replace(upper({c}), '[^А-Я]', '', 'g') = 'БРЮТ' OR {letters} IN ({quoted(W.BRUT_FORMS)}))"


def forms(c: str) -> str:
    return f"[{c}, {fold(c)}, CASE WHEN regexp_full_match({c}, '[\\x00-\\x7F]*') THEN translate({c}, '{W.LOOK_LATIN}', '{W.LOOK_CYRILLIC}') END]"


def _first(items: str, value: str) -> str:
    return f"list_filter(list_transform({items}, lambda f: {value}), lambda v: v IS NOT NULL)[1]"


def colour(c: str, known: str) -> str:
    plain = f"CASE WHEN {mapped('f', W.COLOUR_WORDS)} IS NOT NULL THEN {mapped('f', W.COLOUR_WORDS)} WHEN starts_with(f, 'ОРАНЖ') OR starts_with(f, 'ORANGE') THEN 'orange' WHEN f IN ('WHITE', 'RED', 'ROSE') THEN lower(f) END"
    barred = f"({known} OR contains({c}, 'СТОП') OR starts_with({c}, 'КРАСНОСТ') OR starts_with({c}, 'КРАСНА'))"
    guessed = f"CASE WHEN {barred} THEN NULL WHEN {near(c, 'КРАСНОЕ')} OR {near(c, 'КРАСНЫЙ')} THEN 'red' WHEN {near(c, 'БЕЛОЕ')} OR {near(c, 'БЕЛЫЙ')} THEN 'white' WHEN {near(c, 'РОЗОВОЕ')} OR {near(c, 'РОЗОВЫЙ')} THEN 'rose' WHEN {near(c, 'ОРАНЖЕВОЕ')} THEN 'orange' END"
    return f"coalesce({_first(forms(c), plain)}, {guessed})"


def sweet(c: str) -> str:
    plain = f"CASE WHEN {mapped('f', W.SWEET_WORDS)} IS NOT NULL THEN {mapped('f', W.SWEET_WORDS)} WHEN f = 'DRY' THEN 'dry' WHEN f = 'SWEET' THEN 'sweet' WHEN regexp_matches(f, '^(ПОЛУСЛАД|POLUSLAD)') THEN 'semi_sweet' WHEN regexp_matches(f, '^(ПОЛУСУХ|POLUSUH)') THEN 'semi_dry' END"
    guessed = f"CASE WHEN {near(c, 'СУХОЕ')} OR {near(c, 'СУХОЙ')} THEN 'dry' WHEN {near(c, 'СЛАДКОЕ')} OR {near(c, 'СЛАДКИЙ')} THEN 'sweet' WHEN {near(c, 'ПОЛУСЛАДКОЕ')} THEN 'semi_sweet' WHEN {near(c, 'ПОЛУСУХОЕ')} THEN 'semi_dry' WHEN {near(c, 'БРЮТ')} THEN 'brut' END"
    return f"CASE WHEN {brut(c)} THEN 'brut' ELSE coalesce({_first(forms(c), plain)}, {guessed}) END"


def generic(c: str) -> str:
    return f"({c} IN ({quoted(W.NAME_STOP)}) OR regexp_full_match(translate({c}, 'ОI', '01'), '[0-9]{{4}}'))"


def near_filler(c: str) -> str:
    stop = "[" + quoted(list(dict.fromkeys(W.NAME_STOP))) + "]"
    return f"(length({c}) >= 5 AND {c} NOT IN ({quoted(W.NAME_STOP)}) AND len(list_filter({stop}, lambda s: abs(length(s) - length({c})) <= 1 AND {ratio(c, 's')} >= 0.84)) > 0)"


def repair(c: str) -> str:
    folded = f"translate({c}, '{W.LOOK_LATIN}J', '{W.LOOK_CYRILLIC}Л')"
    return f"(CASE WHEN regexp_full_match(translate({folded}, 'ОI', '01'), '[0-9]+') THEN {folded} ELSE replace({folded}, '3', 'З') END)"


def shown(c: str) -> str:
    return f"(CASE WHEN lower({c}) = 'ultra' THEN 'Ultra' WHEN lower({c}) IN ({quoted(W.STYLE_WORDS)}) THEN lower({c}) ELSE substr({c}, 1, 1) || lower(substr({c}, 2)) END)"


def stems(c: str, items: list[str]) -> str:
    return f"list_filter([{quoted(items)}], lambda s: contains({normalize(c)}, s))"


def sweet_text(c: str) -> str:
    step = "CASE WHEN contains(a.text, s.stem) AND NOT list_contains(a.found, s.label) THEN {'text': replace(a.text, s.stem, ' '), 'found': list_append(a.found, s.label)} ELSE a END"
    items = ", ".join(f"{{'stem': '{k}', 'label': '{v}'}}" for k, v in W.SWEET_STEMS)
    start = "{'text': " + normalize(c) + ", 'found': []::VARCHAR[]}"
    found = f"list_reduce([{items}], lambda a, s: {step}, {start}).found"
    return f"(CASE WHEN len({found}) = 1 THEN ({found})[1] END)"
