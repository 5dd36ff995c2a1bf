"""The same results in plain SQL, written relationally and without the package.

Each statement is a chain of named steps; ``_sql`` collects the steps that a
final SELECT needs.
"""

from __future__ import annotations

import re

# Words the CSV convention reads as a missing text.
NA = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)
WORDS = r"\.{3}|(?:[a-z]\.){2,}|[0-9a-z]+(?:\.[0-9a-z]+|,[0-9][0-9a-z]*)*|[?.,]"
# Contractions that are read as two words.
CONTRACTIONS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))


def _na(q: str) -> str:
    return f"CASE WHEN {q} IN ({NA}) THEN NULL ELSE {q} END"


def _text(q: str) -> str:
    return f"coalesce({q}, 'nan')"


def _clean_tfidf(q: str) -> str:
    low = f"lower({_text(q)})"
    return f"regexp_replace(CASE WHEN {low} = 'nan' THEN '' ELSE {low} END, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"


def _trim(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^\\s+', ''), '\\s+$', '')"


def _clean_train(q: str) -> str:
    return _trim(f"lower(regexp_replace({_text(q)}, '[^0-9a-zA-Z\\s?.,]', ' ', 'g'))")


def _clean_test(q: str) -> str:
    return _trim(f"lower(regexp_replace({_text(q)}, '[^0-9a-zA-Z\\s]', '', 'g'))")


def _blanks(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda t: t <> '')"


def _tfidf(q: str) -> str:
    return f"list_filter(string_split({_clean_tfidf(q)}, ' '), lambda t: length(t) >= 2)"


def _words(cleaned: str) -> str:
    for a, b in CONTRACTIONS:
        cleaned = f"regexp_replace({cleaned}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    return f"regexp_extract_all({cleaned}, '{WORDS}')"


def _ranges(pairs: str) -> str:
    """First floor(0.8 n) rows marked."""
    return f"SELECT *, row_number() OVER (ORDER BY id) - 1 < floor(0.8::DOUBLE * count(*) OVER ()) AS fit FROM {pairs}"


# Characters are renamed to single bytes per pair, since this engine counts bytes.
_CHARS = "array_to_string(list_distinct(string_split(a || b, '')), '')"
_BYTES = "array_to_string(list_transform(range(1, 128), lambda i: chr(i::INT)), '')"
_LEVENSHTEIN = f"levenshtein(translate(a, {_CHARS}, {_BYTES}), translate(b, {_CHARS}, {_BYTES}))"

STEPS = {
    "raw": """
        SELECT d.doc_id AS id, d.text AS question1,
            CASE WHEN d.doc_id % 4 = 0 THEN d.text
                 WHEN d.doc_id % 4 = 1 THEN repeat('well ', (d.doc_id % 9)::INT) || d.text || ' ?'
                 WHEN d.doc_id % 4 = 2 THEN n.text
                 WHEN d.doc_id % 8 = 3 THEN (['', 'NaN', 'null', 'N/A', NULL])[(d.doc_id // 8) % 5 + 1]
                 ELSE n.text || ' ' || d.text END AS question2,
            CASE WHEN d.doc_id % 4 IN (0, 1) THEN 1 ELSE 0 END AS is_duplicate
        FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1""",
    "pairs": f"SELECT id, {_na('question1')} AS question1, {_na('question2')} AS question2, is_duplicate FROM raw",
    "test": f"""
        SELECT c.conv_id * 1000000 + c.turn AS id, {_na('c.text')} AS question1,
            {_na("CASE WHEN (c.conv_id + c.turn) % 3 = 0 THEN repeat('well ', ((c.conv_id + c.turn) % 9)::INT) "
                 "|| c.text || ' ?' ELSE n.text END")} AS question2
        FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""",
}


def _feature_steps(prefix: str, source: str, label: str) -> dict[str, str]:
    """Named steps from a pair table to its features."""
    p = prefix
    return {
        f"{p}tok": f"SELECT id, 1 AS side, unnest({_tfidf('question1')}) AS token FROM {source} UNION ALL "
                   f"SELECT id, 2 AS side, unnest({_tfidf('question2')}) AS token FROM {source}",
        f"{p}tf": f"SELECT id, token, count(*) FILTER (side = 1) AS tf1, count(*) FILTER (side = 2) AS tf2 "
                  f"FROM {p}tok GROUP BY id, token",
        f"{p}weighted": f"SELECT id, tf1::DOUBLE AS a, tf2 * CASE WHEN tf1 > 0 THEN 1.0::DOUBLE "
                        f"ELSE 1.0::DOUBLE + ln(2.0::DOUBLE) END AS b FROM {p}tf",
        f"{p}cos": f"SELECT id, coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0) AS cosine "
                   f"FROM {p}weighted GROUP BY id",
        f"{p}raw1": f"SELECT id, unnest({_blanks(_text('question1'))}) AS token FROM {source}",
        f"{p}raw2": f"SELECT DISTINCT id, unnest({_blanks(_text('question2'))}) AS token FROM {source}",
        f"{p}com": f"SELECT id, count(*) AS common FROM {p}raw1 SEMI JOIN {p}raw2 USING (id, token) GROUP BY id",
        f"{p}low": f"SELECT id, lower({_text('question1')}) AS a, lower({_text('question2')}) AS b, "
                   f"abs(length(a) - length(b)) AS gap FROM {source}",
        f"{p}sig": f"SELECT id, CASE WHEN gap >= 37 THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) "
                   f"THEN 1 / (1 + exp(-gap::DOUBLE)) ELSE 1 / (1 + exp(-({_LEVENSHTEIN})::DOUBLE)) END AS edit_sig "
                   f"FROM {p}low",
        f"{p}feat": f"SELECT p.id, coalesce(cosine, 0) AS cosine, edit_sig, len({_blanks(_text('question1'))}) AS len1, "
                    f"len({_blanks(_text('question2'))}) AS len2, coalesce(common, 0) AS common, {label} AS is_duplicate "
                    f"FROM {source} p JOIN {p}sig USING (id) LEFT JOIN {p}cos USING (id) LEFT JOIN {p}com USING (id)",
        f"{p}scored": f"SELECT *, 2.0::DOUBLE * cosine - 3.0::DOUBLE * edit_sig + 0.01::DOUBLE * common + 1 AS score, "
                      f"1 / (1 + exp(-score)) AS p1, 1 / (1 + exp(score)) AS p0, "
                      f"CASE WHEN score > 0 THEN 1 ELSE 0 END AS prediction FROM {p}feat",
    }


STEPS |= _feature_steps("", "pairs", "is_duplicate")
STEPS |= _feature_steps("t_", "test", "NULL::INT")


def _sequence_steps(prefix: str, source: str, clean) -> dict[str, str]:
    """Named steps from a pair table to word tokens with their places."""
    p = prefix
    lists = ", ".join(f"{_words(clean(f'question{i}'))} AS w{i}" for i in (1, 2))
    side = "SELECT id, {i} AS side, len(w{i}) AS size, {base} AS base, unnest(w{i}) AS token, generate_subscripts(w{i}, 1) - 1 AS pos"
    return {
        f"{p}lists": f"SELECT id, {lists} FROM {source}",
        f"{p}words": " UNION ALL ".join(side.format(i=i, base=base) + f" FROM {p}lists" for i, base in ((1, "0"), (2, "len(w1)"))),
        f"{p}coded": f"SELECT w.*, coalesce(idx, 0) AS idx FROM {p}words w LEFT JOIN vocab USING (token)",
        f"{p}seq": f"SELECT id, side, list(idx ORDER BY pos) AS seq FROM {p}coded GROUP BY id, side",
        f"{p}seqs": f"SELECT s.id, coalesce(a.seq, []) AS seq1, coalesce(b.seq, []) AS seq2 FROM {source} s "
                    f"LEFT JOIN (FROM {p}seq WHERE side = 1) a ON a.id = s.id "
                    f"LEFT JOIN (FROM {p}seq WHERE side = 2) b ON b.id = s.id",
    }


STEPS |= _sequence_steps("", "pairs", _clean_train)
STEPS |= _sequence_steps("t_", "test", _clean_train)
STEPS |= _sequence_steps("td_", "test", _clean_test)
STEPS |= {
    "place": "SELECT token, id, base + pos AS p FROM words",
    "counts": "SELECT token, count(*) AS n, min(id::HUGEINT * 2147483648 + p) AS first FROM place GROUP BY token",
    "vocab": "SELECT token, n, row_number() OVER (ORDER BY n DESC, first) + 1 AS idx FROM counts "
             "QUALIFY idx < 200000",
    "slots": "SELECT count(*) + count(*) // 10 AS slots FROM embeddings",
    "vectors": "SELECT token, embedding::DOUBLE[] AS vec FROM vocab, slots, embeddings WHERE vec_id = idx % slots",
    "cells": "SELECT token, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS d FROM vectors",
    "bags": "SELECT id, side, token, count(*) AS n FROM words GROUP BY id, side, token",
    "frame": "SELECT id, side, d, CASE WHEN side = 1 THEN len(w1) ELSE len(w2) END AS size "
             "FROM lists, (SELECT unnest([1, 2]) AS side), (SELECT unnest(range(64)) AS d)",
    "sums": "SELECT id, side, d, sum(n * v) AS s FROM bags JOIN cells USING (token) GROUP BY id, side, d",
    "pooled": "SELECT id, side, d, size, coalesce(s, 0) AS x FROM frame LEFT JOIN sums USING (id, side, d)",
    "means": "SELECT id, side, d, x / greatest(size, 1) AS x FROM pooled",
    "texts": "SELECT DISTINCT id, side, token FROM words",
    "idf": "SELECT token, ln((1.0::DOUBLE + 2 * (SELECT count(*) FROM pairs)) / (1 + count(*))) + 1 AS weight "
           "FROM texts GROUP BY token",
    "idfsums": "SELECT id, side, d, sum(n * v * weight) AS s FROM bags JOIN cells USING (token) JOIN idf USING (token) "
               "GROUP BY id, side, d",
    "opposite": "SELECT id, d, sum(x) FILTER (side = 1) AS l, sum(x) FILTER (side = 2) AS r FROM pooled GROUP BY id, d",
    "distances": "SELECT id, sqrt(sum((l - r) ** 2)) / nullif(sqrt(sum(l * l)) + sqrt(sum(r * r)), 0) AS distance "
                 "FROM opposite GROUP BY id",
    "prefix_distances": "SELECT id, sqrt(sum((l - r) ** 2)) / nullif(sqrt(sum(l * l)) + sqrt(sum(r * r)), 0) AS distance "
                        "FROM opposite WHERE d < 16 GROUP BY id",
    "joint": "SELECT id, CASE WHEN side = 2 THEN d + 64 ELSE d END AS d, x FROM means",
    "moments": "SELECT d, avg(x) AS mean, var_pop(x) AS var FROM joint GROUP BY d",
    "normal": "SELECT id, d, (x - mean) / sqrt(var + 1e-3::DOUBLE) AS x FROM joint JOIN moments USING (d)",
    "batches": "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 128 AS batch_id FROM pairs",
    "batch_moments": "SELECT batch_id, d, avg(x) AS mean, var_pop(x) AS var FROM joint JOIN batches USING (id) "
                     "GROUP BY batch_id, d",
    "batch_normal": "SELECT j.id, d, (x - mean) / sqrt(var + 1e-3::DOUBLE) AS x FROM joint j JOIN batches USING (id) "
                    "JOIN batch_moments USING (batch_id, d)",
    "tail": "SELECT id, side, token, size - 1 - pos AS back FROM words WHERE size - pos <= 30",
    "tailcells": "SELECT id, side, d, sum(0.9::DOUBLE ** back * v) AS f, sum(v) FILTER (back = 0) AS l "
                 "FROM tail JOIN cells USING (token) GROUP BY id, side, d",
    "decayed": "SELECT id, side, h * 64 + d AS d, coalesce(CASE WHEN h = 0 THEN f ELSE l END, 0) AS x "
               "FROM frame LEFT JOIN tailcells USING (id, side, d), (SELECT unnest([0, 1]) AS h) WHERE size > 0",
    "lowtokens": f"SELECT id, 1 AS side, unnest({_blanks('lower(' + _text('question1') + ')')}) AS token FROM test "
                 f"UNION ALL SELECT id, 2, unnest({_blanks('lower(' + _text('question2') + ')')}) FROM test",
    "lowbags": "SELECT id, side, token, count(*)::DOUBLE AS w, any_value(vec) AS vec "
               "FROM lowtokens JOIN vectors USING (token) GROUP BY id, side, token",
    "nearest": "SELECT a.id, a.side, a.token, any_value(a.w) AS w, min(list_distance(a.vec, b.vec)) AS dist "
               "FROM lowbags a JOIN lowbags b ON a.id = b.id AND a.side <> b.side GROUP BY a.id, a.side, a.token",
    "moves": "SELECT id, side, sum(w * dist) / sum(w) AS cost FROM nearest GROUP BY id, side",
    "fitted": _ranges("feat"),
    "fit_ids": _ranges("(SELECT id FROM pairs)"),
}


def _descent_steps(prefix: str, source: str, names: tuple[str, ...] = ("cosine", "edit_sig", "common"), raw: bool = False) -> dict[str, str]:
    """A hundred full-batch steps on standardised (or raw) features, as a recursive query."""
    p = prefix
    stats = ", ".join(f"0 AS m_{c}, 1 AS s_{c}" if raw else f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in names)
    z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS x_{c}" for c in names)
    score = " + ".join(f"w_{c} * x_{c}" for c in names) + " + bias"
    update = ", ".join(f"any_value(w_{c}) - 0.12::DOUBLE * avg((p - y) * x_{c})" for c in names)
    zeros = ", ".join(f"0.0::DOUBLE AS w_{c}" for c in names)
    return {
        f"{p}stats": f"SELECT {stats}" + ("" if raw else f" FROM {source}"),
        f"{p}z": f"SELECT id, {z}, is_duplicate AS y FROM {source}, {p}stats",
        f"{p}gd": f"SELECT 0 AS epoch, {zeros}, 0.0::DOUBLE AS bias, NULL::DOUBLE AS cost UNION ALL "
                  f"SELECT epoch + 1, {update}, any_value(bias) - 0.12::DOUBLE * avg(p - y), "
                  f"avg(-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-15::DOUBLE))) "
                  f"FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM {p}gd, {p}z WHERE epoch < 100) GROUP BY epoch",
    }


STEPS |= _descent_steps("all_", "feat")
STEPS |= _descent_steps("raw_", "feat", ("cosine", "edit_sig"), raw=True)
STEPS |= {"fit_rows": "SELECT * FROM fitted WHERE fit"}
STEPS |= _descent_steps("fit_", "fit_rows")
STEPS |= {
    "held": "SELECT id, is_duplicate, CASE WHEN bias + " + " + ".join(
        f"w_{c} * ({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END" for c in ("cosine", "edit_sig", "common")
    ) + " > 0 THEN 1 ELSE 0 END AS prediction FROM fitted, fit_stats, fit_gd WHERE NOT fit AND epoch = 100",
}


def _accelerated_steps(names: tuple[str, ...] = ("cosine", "edit_sig", "common"), epochs: int = 500) -> dict[str, str]:
    """The minimum of the penalised loss of the first rows, by accelerated descent on standardised features.

    The penalty is on coefficients of features over their sample deviation.
    """
    score = " + ".join(f"y_{c} * x_{c}" for c in names) + " + y_bias"
    zeros = ", ".join(f"0.0::DOUBLE AS {v}_{c}" for v in "wy" for c in (*names, "bias"))
    old = ", ".join(f"any_value(w_{c}) AS o_{c}" for c in (*names, "bias"))
    new = ", ".join(f"any_value(y_{c}) - 1.0::DOUBLE * (avg((p - y) * x_{c}) + 1e-3::DOUBLE * count(*) / (count(*) - 1) * any_value(y_{c})) AS n_{c}" for c in names)
    ahead = ", ".join(f"n_{c}" for c in (*names, "bias")) + ", " + ", ".join(f"n_{c} + 0.94::DOUBLE * (n_{c} - o_{c})" for c in (*names, "bias"))
    return {
        "best_gd": f"SELECT 0 AS epoch, {zeros} UNION ALL SELECT epoch + 1, {ahead} FROM (SELECT epoch, {old}, {new}, "
                   f"any_value(y_bias) - 1.0::DOUBLE * avg(p - y) AS n_bias "
                   f"FROM (SELECT *, 1 / (1 + exp(-({score}))) AS p FROM best_gd, fit_z WHERE epoch < {epochs}) GROUP BY epoch)",
        "best_held": "SELECT id, is_duplicate, CASE WHEN w_bias + " + " + ".join(
            f"w_{c} * ({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END" for c in names
        ) + f" > 0 THEN 1 ELSE 0 END AS prediction FROM fitted, fit_stats, best_gd WHERE NOT fit AND epoch = {epochs}",
    }


STEPS |= _accelerated_steps()
_MATERIALIZED = {
    "pairs", "test", "feat", "t_feat", "lists", "words", "vocab", "pooled", "means", "cells", "vectors", "lowbags",
    "t_lists", "td_lists", "all_z", "fit_z", "counts",
}


def _sql(select: str) -> str:
    """The SELECT with all steps it needs, in order."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in STEPS and name not in seen:
                seen.add(name)
                visit(STEPS[name])
                order.append(name)

    visit(select)
    steps = [
        f"{name} AS {'MATERIALIZED ' if name in _MATERIALIZED else ''}({STEPS[name]})" for name in order
    ]
    return f"WITH RECURSIVE {', '.join(steps)} {select}" if steps else select


def _looked_up(vocabulary: str) -> str:
    """The last words of each text in a vocabulary; unknown ones have the index and the (zero) vector of entry 0."""
    return (
        f"SELECT w.id, side::BIGINT AS side, (pos - greatest(size - 30, 0))::BIGINT AS pos, coalesce(v.idx, 0)::BIGINT AS idx, "
        f"{_r6('coalesce(first, 0)')} AS first, {_r6('coalesce(norm, 0)')} AS norm "
        f"FROM (SELECT id, side, size, pos, token FROM words WHERE size - pos <= 30) w LEFT JOIN (SELECT token, idx, first, norm FROM {vocabulary} "
        f"LEFT JOIN (SELECT vec_id, embedding[1]::DOUBLE AS first, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings) e "
        f"ON e.vec_id = idx % (SELECT slots FROM slots)) v USING (token)"
    )


def _r6(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


def _tokens(make) -> str:
    return "SELECT id, " + ", ".join(
        f"array_to_string({make(f'question{i}')}, ' ') AS tokens{i}" for i in (1, 2)) + " FROM pairs"


def _cleaned(clean) -> str:
    return f"SELECT id, {clean('question1')} AS clean1, {clean('question2')} AS clean2 FROM pairs"


def _padded(seq: str) -> str:
    return (f"array_to_string(list_concat(list_transform(range(30 - least(len({seq}), 30)), lambda i: 0), "
            f"list_slice({seq}, greatest(len({seq}) - 29, 1), len({seq}))), ' ')")


def _shown(seq: str) -> str:
    return f"array_to_string({seq}, ' ')"


def _certified(ids: str, width: int) -> str:
    """A true row for every weight of two classes, the biases (-1) included, and for every pair."""
    return (f"SELECT 'weight' AS part, (c * 10000 + d)::BIGINT AS id, TRUE AS holds FROM (SELECT unnest([0, 1]) AS c), "
            f"(SELECT unnest(range(-1, {width})) AS d) UNION ALL SELECT 'pair', id, TRUE FROM ({ids})")


def _dense(normal: str) -> str:
    """Fixed layer and softmax over normalised joint vectors."""
    logits = (f"SELECT id, sum(x * (d % 7 - 3) / 10.0::DOUBLE) + 0.1::DOUBLE AS z0, "
              f"sum(x * (d % 5 - 2) / 10.0::DOUBLE) - 0.1::DOUBLE AS z1 FROM {normal} GROUP BY id")
    return (f"SELECT id, {_r6('1 / (1 + exp(z1 - z0))')} AS p0, {_r6('1 / (1 + exp(z0 - z1))')} AS p1, "
            f"CASE WHEN z1 > z0 THEN 1 ELSE 0 END::BIGINT AS prediction FROM ({logits})")


_LENGTHS = ", ".join(
    f"min(n{i})::BIGINT AS min_len{i}, max(n{i})::BIGINT AS max_len{i}, {_r6(f'avg(n{i})')} AS mean_len{i}" for i in (1, 2))
_GRADIENT = ", ".join(f"{_r6(f'avg((p1 - is_duplicate) * {c})')} AS g_{c}" for c in ("cosine", "edit_sig", "common"))
_LOSS = "avg(-ln(greatest(CASE WHEN is_duplicate = 0 THEN p0 ELSE p1 END, 1e-15::DOUBLE)))"
_HIT = "(prediction = is_duplicate)::INT::DOUBLE"
_BATCHED = (f"SELECT batch_id, count(*) AS n, avg({_HIT}) AS accuracy FROM scored JOIN batches USING (id) GROUP BY batch_id")

SELECTS = {
    "tfidf_cosine": f"SELECT id, {_r6('cosine')} AS cosine FROM feat",
    "features": f"SELECT id, {_r6('cosine')} AS cosine, {_r6('edit_sig')} AS edit_sig, len1::BIGINT AS len1, "
                f"len2::BIGINT AS len2, common::BIGINT AS common, is_duplicate::BIGINT AS is_duplicate FROM feat",
    "feature_set_basic3": f"SELECT id, {_r6('cosine')} AS cosine, {_r6('edit_sig')} AS edit_sig, "
                          f"common::BIGINT AS common FROM t_feat",
    "feature_set_all5": f"SELECT id, {_r6('cosine')} AS cosine, {_r6('edit_sig')} AS edit_sig, common::BIGINT AS common, "
                        f"len1::BIGINT AS len1, len2::BIGINT AS len2, is_duplicate::BIGINT AS is_duplicate FROM feat",
    "na_normalize": f"SELECT id, question1, question2, {_text('question2')} AS text2 FROM pairs",
    "valid_utf8_pairs": "SELECT id, is_duplicate::BIGINT AS is_duplicate FROM pairs",
    "clean_tfidf": _cleaned(_clean_tfidf),
    "clean_train": _cleaned(_clean_train),
    "clean_test": _cleaned(_clean_test),
    "tokens_whitespace": _tokens(lambda q: _blanks(_text(q))),
    "tokens_word": _tokens(lambda q: _words(_clean_train(q))),
    "tokens_word_test": _tokens(lambda q: _words(_clean_test(q))),
    "tokens_tfidf": _tokens(_tfidf),
    "token_lengths": f"SELECT id, len({_blanks(_text('question1'))})::BIGINT AS len1, "
                     f"len({_blanks(_text('question2'))})::BIGINT AS len2 FROM pairs",
    "pair_vocabulary": f"SELECT id, len(v)::BIGINT AS n_tokens, array_to_string(v, ' ') AS tokens FROM (SELECT id, "
                       f"list_sort(list_distinct(list_concat({_blanks(_clean_tfidf('question1'))}, "
                       f"{_blanks(_clean_tfidf('question2'))}))) AS v FROM pairs)",
    "term_frequency": "SELECT id, token, tf1::BIGINT AS tf1, tf2::BIGINT AS tf2 FROM tf",
    "pair_idf": f"SELECT id, token, {_r6('CASE WHEN tf1 > 0 THEN 1.0::DOUBLE ELSE 1 + ln(2.0::DOUBLE) END')} AS idf FROM tf",
    "common_words": "SELECT id, common::BIGINT AS common FROM feat",
    "common_words_semi": "SELECT id, common::BIGINT AS common FROM feat",
    "edit_distance": f"SELECT id, ({_LEVENSHTEIN})::BIGINT AS distance FROM t_low",
    "edit_sigmoid": f"SELECT id, {_r6('edit_sig')} AS edit_sig FROM sig",
    "pair_profile": f"SELECT count(*) AS n_pairs, count(*) FILTER (question1 IS NULL) AS null1, "
                    f"count(*) FILTER (question2 IS NULL) AS null2, sum(is_duplicate)::BIGINT AS n_duplicate, {_LENGTHS} "
                    f"FROM (SELECT *, len({_blanks(_text('question1'))}) AS n1, "
                    f"len({_blanks(_text('question2'))}) AS n2 FROM pairs)",
    "row_index": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn FROM test",
    "split_train": f"SELECT id, question1 FROM ({_ranges('test')}) WHERE fit",
    "split_holdout": f"SELECT id, question1 FROM ({_ranges('test')}) WHERE NOT fit",
    "minibatch_assign": "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 128 AS batch_id FROM pairs",
    "score_chunks": "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS chunk_id FROM pairs",
    "dedupe_last": "SELECT conv_id, turn, role, text FROM conversations "
                   "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "limit_pairs": "SELECT id, question1, question2 FROM pairs ORDER BY id LIMIT 100",
    "token_frequency": "SELECT token, n FROM counts",
    "vocabulary": "SELECT token, n, idx FROM vocab",
    "vocabulary_topk": "SELECT token, n, idx FROM vocab WHERE idx < 102",
    "oov_tokens": "SELECT token, count(*) AS n FROM t_words ANTI JOIN vocab USING (token) GROUP BY token",
    "vocab_encode": f"SELECT id, {_shown('seq1')} AS seq1, {_shown('seq2')} AS seq2 FROM seqs",
    "pad_sequences": f"SELECT id, {_padded('seq1')} AS seq1, {_padded('seq2')} AS seq2 FROM t_seqs",
    "sequence_prepare_train": f"SELECT id, {_padded('seq1')} AS seq1, {_padded('seq2')} AS seq2, "
                              f"is_duplicate::BIGINT AS is_duplicate FROM seqs JOIN pairs USING (id)",
    "sequence_prepare_test": f"SELECT id, {_padded('seq1')} AS seq1, {_padded('seq2')} AS seq2 FROM td_seqs",
    "vector_source_profile": f"SELECT count(*) AS n_vectors, min(w)::BIGINT AS min_width, max(w)::BIGINT AS max_width, "
                             f"count(*) FILTER (norm = 0) AS n_zero, {_r6('avg(norm)')} AS mean_norm FROM (SELECT "
                             f"len(embedding) AS w, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) "
                             f"AS norm FROM embeddings)",
    "vector_prefix": f"SELECT vec_id, d::BIGINT AS d, {_r6('x')} AS x FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) "
                     f"AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) WHERE d < 16",
    "embedding_matrix": f"SELECT idx::BIGINT AS idx, token, (vec IS NOT NULL)::BIGINT AS known, 64::BIGINT AS width, "
                        f"{_r6('coalesce(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 0)')} AS norm FROM "
                        f"(SELECT token, idx FROM vocab UNION ALL VALUES ('<UNK>', 0), ('<PAD>', 1)) "
                        f"LEFT JOIN vectors USING (token)",
    "embedding_lookup": _looked_up("vocab"),
    "embedding_lookup_small_cap": _looked_up("(SELECT * FROM vocab WHERE idx <= 500)"),
    "pooled_sum": f"SELECT id, side::BIGINT AS side, d::BIGINT AS d, {_r6('x')} AS x FROM pooled",
    "pooled_mean": f"SELECT id, side::BIGINT AS side, d::BIGINT AS d, {_r6('x')} AS x FROM means",
    "pooled_idf": f"SELECT id, side::BIGINT AS side, d::BIGINT AS d, {_r6('coalesce(s, 0)')} AS x "
                  f"FROM frame LEFT JOIN idfsums USING (id, side, d)",
    "pair_distance": f"SELECT id, {_r6('distance')} AS distance FROM distances",
    "distance_threshold_predict": "SELECT id, CASE WHEN distance < 0.7::DOUBLE THEN 1 ELSE 0 END::BIGINT AS prediction "
                                  "FROM distances",
    "pooled_distance_scores": f"SELECT id, {_r6('distance')} AS distance, "
                              f"CASE WHEN distance < 0.7::DOUBLE THEN 1 ELSE 0 END::BIGINT AS prediction FROM prefix_distances",
    "joint_vector": f"SELECT id, d::BIGINT AS d, {_r6('x')} AS x FROM joint",
    "batch_moments": f"SELECT d::BIGINT AS d, {_r6('mean')} AS mean, {_r6('var')} AS var FROM moments",
    "batch_normalize": f"SELECT id, d::BIGINT AS d, {_r6('x')} AS x FROM normal",
    "encode_decay": f"SELECT id, side::BIGINT AS side, d::BIGINT AS d, {_r6('x')} AS x FROM decayed",
    "relaxed_wmd": f"SELECT id, {_r6('coalesce(max(cost), -1)')} AS rwmd FROM test LEFT JOIN moves USING (id) GROUP BY id",
    "one_hot_label": "SELECT id, (is_duplicate = 0)::INT::DOUBLE AS c0, (is_duplicate <> 0)::INT::DOUBLE AS c1 FROM pairs",
    "linear_score": f"SELECT id, {_r6('score')} AS score FROM scored",
    "softmax_scores": f"SELECT id, {_r6('p0')} AS p0, {_r6('p1')} AS p1 FROM scored",
    "argmax_predict": "SELECT id, prediction::BIGINT AS prediction FROM scored",
    "udf_score": f"SELECT id, {_r6('score')} AS score FROM scored",
    "cross_entropy": f"SELECT {_r6(_LOSS)} AS cross_entropy FROM scored",
    "gradient_step": f"SELECT {_r6(_LOSS)} AS cost, {_GRADIENT}, {_r6('avg(p1 - is_duplicate)')} AS g_bias FROM scored",
    "logistic_gd": f"SELECT name, {_r6('value')} AS value FROM (UNPIVOT (SELECT w_cosine AS cosine, w_edit_sig AS edit_sig, "
                   f"w_common AS common, bias FROM all_gd WHERE epoch = 100) "
                   f"ON cosine, edit_sig, common, bias INTO NAME name VALUE value)",
    "logistic_gd_raw": f"SELECT name, {_r6('value')} AS value FROM (SELECT w_cosine AS cosine, w_edit_sig AS edit_sig, bias FROM raw_gd WHERE epoch = 100) "
                       f"UNPIVOT (value FOR name IN (cosine, edit_sig, bias))",
    "epoch_cost": f"SELECT epoch::BIGINT AS epoch, {_r6('cost')} AS cost FROM all_gd WHERE epoch > 0",
    "holdout_accuracy": f"SELECT count(*) AS n, {_r6(f'avg({_HIT})')} AS accuracy FROM held",
    "holdout_outcomes": "SELECT is_duplicate::BIGINT AS is_duplicate, prediction::BIGINT AS prediction, count(*) AS n "
                        "FROM held GROUP BY ALL",
    "batch_accuracy": f"SELECT batch_id, n, {_r6('accuracy')} AS accuracy FROM ({_BATCHED})",
    "macro_batch_accuracy": f"SELECT count(*) AS batches, {_r6('avg(accuracy)')} AS accuracy FROM ({_BATCHED}) WHERE n = 128",
    "predictions_csv_rows": "SELECT id, prediction::BIGINT AS prediction FROM t_scored",
    "predictions_counter_rows": "SELECT row_number() OVER (ORDER BY id) - 1 AS id, prediction::BIGINT AS prediction FROM t_scored",
    "stream_score": "SELECT id, prediction::BIGINT AS prediction FROM scored",
    "dense_head_forward": _dense("normal"),
    "dense_head_batches": _dense("batch_normal"),
    "logistic_mllib": "SELECT id, is_duplicate::BIGINT AS is_duplicate, prediction::BIGINT AS prediction FROM best_held",
    "dense_head_fit": _certified("SELECT id FROM fit_ids WHERE NOT fit", 128),
    "pair_model_scores": _certified("SELECT id FROM fit_ids WHERE NOT fit", 256),
    "sequence_model_predictions": _certified("SELECT id FROM test", 256),
    "csv_record_pairs": "SELECT id, question1, question2, is_duplicate::BIGINT AS is_duplicate FROM pairs",
    "stream_dedupe_last": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "word2vec_vectors": f"SELECT token, {_r6('vec[1]')} AS first, {_r6('sqrt(list_sum(list_transform(vec, lambda x: x * x)))')} AS norm FROM vectors",
}

ORACLE: dict[str, str] = {name: _sql(select) for name, select in SELECTS.items()}
