"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .divergence import COMMON, Limits
from .divergence import WORDS as COMMON_WORDS
from .reputation import Reputation

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
FOLDED = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"


def _distance_sql(counts: str, total: str, other: str) -> str:
    """Jensen-Shannon distance (base 2) of counts, whose sum is total, from the counts of other."""
    bits = lambda p: f"list_sum(list_transform({p}, lambda x: CASE WHEN x > 0 THEN -x * log2(x) ELSE 0.0 END))"
    p, q = f"list_transform({counts}, lambda x: x / {total})", f"list_transform({other}, lambda x: x / list_sum({other}))"
    middle = f"list_transform(list_zip({p}, {q}), lambda z: (z[1] + z[2]) / 2)"
    return f"CASE WHEN {total} > 0 AND list_sum({other}) > 0 THEN sqrt(greatest({bits(middle)} - ({bits(p)} + {bits(q)}) / 2, 0.0)) END"


def divergence(limits: Limits = Limits()) -> str:
    class_ = lambda chars: f"CAST(len(regexp_replace(t, '[^{chars}]', '', 'g')) AS DOUBLE)"
    listed = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"
    guard = lambda d, limit, enough: f"coalesce({d}, 0.0) / {limit} * CASE WHEN {enough} THEN 1.0 ELSE 0.0 END"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    win AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5), five AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM win),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM five JOIN (SELECT r, s FROM five GROUP BY ALL HAVING count(*) > 1) USING (r, s), (SELECT unnest(range(5)) AS k) GROUP BY r),
    c AS (SELECT *, {class_('\\p{L}')} AS letter, {class_('\\p{Lu}')} AS capital, {class_('\\p{Nd}')} AS digit, {class_('\\x20\\x09-\\x0D')} AS space, {class_(r'#*$%&|<>!@^~_=+\\/\[\]{}')} AS symbol FROM d),
    m AS MATERIALIZED (SELECT r, doc_id, lang, len(w) AS n_words, CAST(len(t) - space AS BIGINT) AS word_chars, CAST({class_('#*$%&|<>')} AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(t) AS n_class,
        [letter - capital, capital, digit, space, symbol, len(t) - letter - digit - space - symbol] AS classes FROM c LEFT JOIN rep USING (r)),
    low AS (SELECT r, lower(unnest(w)) AS word FROM d), com AS (SELECT r, word, count(*) AS n FROM low WHERE list_contains({listed}, word) GROUP BY ALL),
    cm AS (SELECT r, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY place) AS common FROM (SELECT d.r, place, n FROM d CROSS JOIN (SELECT unnest({listed}) AS word, unnest(range({len(COMMON_WORDS)})) AS place) x LEFT JOIN com ON com.r = d.r AND com.word = x.word) GROUP BY r),
    y AS MATERIALIZED (SELECT *, list_append(common, n_words - list_sum(common)) AS commons, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeated_percent} * n_words AS base_failed FROM m JOIN cm USING (r)),
    ref AS MATERIALIZED (SELECT a.lang, a.classes, b.commons FROM (SELECT lang, list(x ORDER BY i) AS classes FROM (SELECT lang, i, sum(x) AS x FROM (SELECT lang, unnest(classes) AS x, unnest(range(len(classes))) AS i FROM y WHERE NOT base_failed) GROUP BY ALL) GROUP BY lang) a
        JOIN (SELECT lang, list(x ORDER BY i) AS commons FROM (SELECT lang, i, sum(x) AS x FROM (SELECT lang, unnest(commons) AS x, unnest(range(len(commons))) AS i FROM y WHERE NOT base_failed) GROUP BY ALL) GROUP BY lang) b USING (lang) WHERE lang IN ({', '.join(f"'{k}'" for k in COMMON)})),
    z AS (SELECT y.r, {_distance_sql('y.classes', 'n_class', 'ref.classes')} AS dc, {_distance_sql('y.commons', 'n_words', 'ref.commons')} AS dw, n_class, n_words FROM y CROSS JOIN ref),
    g AS (SELECT r, min(greatest({guard('dc', limits.class_distance, f'n_class >= {limits.least_characters}')}, {guard('dw', limits.word_distance, f'n_words >= {limits.least_length}')})) AS over, min(dc) AS dc, min(dw) AS dw FROM z GROUP BY r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ((lang IS NOT NULL AND lang NOT IN (SELECT lang FROM ref)) OR coalesce(over, 0.0) <= 1.0) AS kept, round(dc, 6) AS class_distance, round(dw, 6) AS word_distance FROM y LEFT JOIN g USING (r)"""


def shards(n_shards: int = 24, bins: int = 4096) -> str:
    """CRC-32 byte by byte over its table, and the jump hash step by step in 128-bit arithmetic."""
    def entry(c: int) -> int:
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        return c

    crc_table = "[" + ", ".join(str(entry(i)) for i in range(256)) + "]"
    jump = lambda n: f"""CAST(list_reduce(range({n + 1}), lambda s, k: CASE WHEN s.ahead >= {n} THEN s ELSE {{'key': (s.key * 2862933555777941757 + 1) % 18446744073709551616, 'at': floor(s.ahead),
        'ahead': (floor(s.ahead) + 1) * (CAST(2147483648 AS DOUBLE) / CAST((s.key * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592 + 1 AS DOUBLE))}} END, {{'key': CAST(key AS UHUGEINT), 'at': CAST(-1 AS DOUBLE), 'ahead': CAST(0 AS DOUBLE)}}).at AS INT)"""  # noqa: E731
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
    b AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(hex(encode(t)), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
    c AS (SELECT doc_id, CAST(len(bytes) + 8 AS BIGINT) AS size, xor(CASE WHEN len(bytes) = 0 THEN 4294967295 ELSE list_reduce(bytes, lambda c, x: xor({crc_table}[(xor(c, x) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)) END, 4294967295) AS text_crc32,
        CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS key, CAST('0x' || substr(digest, 16, 6) AS BIGINT) % {bins} AS bin FROM b),
    s AS (SELECT *, {jump(n_shards)} AS shard, {jump(n_shards + 1)} AS grown_shard FROM c)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bin, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM s"""


def _dealt_sql(kids: str) -> str:
    """(parent, name, got): each parent's budget among kids (parent, budget, name, room, weight). Every round either fills
    those that cannot use their share or deals what is left by weight, whole tokens first by name."""
    kid, state = "STRUCT(name VARCHAR, room DOUBLE, weight DOUBLE)", "STRUCT(budget DOUBLE, live STRUCT(name VARCHAR, room DOUBLE, weight DOUBLE)[], got STRUCT(name VARCHAR, got DOUBLE)[])"
    share = "s.budget * x.weight / list_sum(list_transform(s.live, lambda y: y.weight))"
    full = f"list_filter(s.live, lambda x: x.room <= {share})"
    rest = f"(s.budget - list_sum(list_transform(s.live, lambda x: floor({share}))))"
    last = f"{{'budget': CAST(0 AS DOUBLE), 'live': CAST([] AS {kid}[]), 'got': list_concat(s.got, list_transform(s.live, lambda x, i: {{'name': x.name, 'got': floor({share}) + CASE WHEN i <= {rest} THEN 1 ELSE 0 END}}))}}"
    more = f"{{'budget': s.budget - list_sum(list_transform({full}, lambda x: x.room)), 'live': list_filter(s.live, lambda x: x.room > {share}), 'got': list_concat(s.got, list_transform({full}, lambda x: {{'name': x.name, 'got': x.room}}))}}"
    step = f"CASE WHEN len(s.live) = 0 THEN s WHEN len({full}) = 0 THEN CAST({last} AS {state}) ELSE CAST({more} AS {state}) END"
    return f"""SELECT parent, unnest(z.got).name AS name, unnest(z.got).got AS got FROM (SELECT parent, list_reduce(range(max(n)), lambda s, r: {step},
        CAST({{'budget': CAST(least(max(budget), sum(room)) AS DOUBLE), 'live': list({{'name': name, 'room': room, 'weight': weight}} ORDER BY name), 'got': []}} AS {state})) AS z
        FROM (SELECT *, count(*) OVER (PARTITION BY parent) + 1 AS n FROM ({kids}) WHERE weight > 0 AND room > 0) GROUP BY parent)"""


def mix(domains: dict[str, float], langs: dict[str, float], fraction: float, epochs: int, seed: int) -> str:
    weight = lambda c, w: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " ELSE 0 END"
    return f"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(CASE WHEN regexp_extract(coalesce(source, ''), '([0-9])$', 1) IN ('1', '3', '5', '7', '9') THEN 'press' ELSE 'forum' END, '?') AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
        CAST(len({WORDS}) AS DOUBLE) AS tokens, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || sha256(coalesce(text, '')) AS key FROM documents),
    leaf AS MATERIALIZED (SELECT domain, lang, source, sum(tokens) AS supply, CAST({weight('domain', domains)} AS DOUBLE) AS wd, CAST({weight('lang', langs)} AS DOUBLE) AS wl FROM t GROUP BY ALL),
    use AS MATERIALIZED (SELECT *, supply * {epochs} AS room FROM leaf WHERE wd > 0 AND wl > 0), top AS (SELECT least(floor({fraction} * (SELECT sum(supply) FROM leaf)), sum(room)) AS budget FROM use),
    d AS MATERIALIZED ({_dealt_sql("SELECT '' AS parent, any_value(budget) AS budget, domain AS name, sum(room) AS room, any_value(wd) AS weight FROM use, top GROUP BY domain")}),
    l AS MATERIALIZED ({_dealt_sql("SELECT domain AS parent, any_value(got) AS budget, lang AS name, sum(room) AS room, any_value(wl) AS weight FROM use JOIN d ON d.name = domain GROUP BY domain, lang")}),
    s AS MATERIALIZED ({_dealt_sql("SELECT domain || '|' || lang AS parent, any_value(got) AS budget, source AS name, sum(room) AS room, CAST(1 AS DOUBLE) AS weight FROM use JOIN l ON l.parent = domain AND l.name = lang GROUP BY domain, lang, source")}),
    cap AS (SELECT domain, lang, source, epoch, least(got - epoch * supply, supply) AS cap FROM use JOIN s ON s.parent = domain || '|' || lang AND s.name = source, (SELECT unnest(range({epochs})) AS epoch) WHERE got > epoch * supply),
    o AS (SELECT t.*, epoch, cap, md5('{seed}:' || epoch || ':' || key) AS place FROM t JOIN cap USING (domain, lang, source)),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place) AS upto FROM o)
    SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INT) AS epoch FROM c WHERE upto <= cap"""


def top_k() -> str:
    return """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
    s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


def negatives() -> str:
    return """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
    p AS MATERIALIZED (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


def substrings() -> str:
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
    win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
    least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, i + d AS pos FROM (SELECT win.doc_id, win.i, unnest(range(50)) AS d FROM win JOIN least USING (s) WHERE win.doc_id > m)),
    long AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM long ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def near_duplicates() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    long AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def url_reputation(rules: list[tuple[str, str, str]], p: Reputation = Reputation()) -> str:
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{t}')" for _, h, t in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{t}'" for f, (_, h, t) in zip(fits, order, strict=True)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, order, strict=True)) + " END"
    moments = lambda by: f"SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM (SELECT {by}, sum(n) AS n, sum(bad) AS bad FROM known GROUP BY {by})"
    strength = lambda by: f"""(SELECT CASE WHEN coalesce(n, 0) = 0 OR k < 2 THEN {p.most_strength} WHEN n - nn / n <= 0 OR bad = 0 OR bad = n THEN {p.most_strength} WHEN between_ <= 0 THEN {p.most_strength}
        ELSE least(greatest(bad / n * (1 - bad / n) / between_ - 1, {p.least_strength}), {p.most_strength}) END
        FROM (SELECT *, (bb - n * (bad / n) * (bad / n) - (k - 1) * (bad / n) * (1 - bad / n)) / (n - nn / n) AS between_ FROM ({moments(by)})))"""  # noqa: E731
    return f"""WITH p AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') ELSE '' END AS host,
        CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
    known AS MATERIALIZED (SELECT host, regexp_extract(host, '(?:[^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS bad
        FROM p JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) GROUP BY host),
    k AS MATERIALIZED (SELECT {strength('suffix')} AS k1, {strength('domain')} AS k2, {strength('host')} AS k3, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM known) AS overall),
    su AS (SELECT suffix, m AS suffix_mean, m * (1 - m) / (n + k1 + 1) AS suffix_doubt FROM (SELECT suffix, sum(n) AS n, any_value(k1) AS k1, (sum(bad) + any_value(k1) * any_value(overall)) / (sum(n) + any_value(k1)) AS m FROM known, k GROUP BY suffix)),
    dom AS (SELECT domain, m AS domain_mean, m * (1 - m) / (n + k2 + 1) + (k2 / (n + k2)) * (k2 / (n + k2)) * suffix_doubt AS domain_doubt FROM (SELECT domain, sum(n) AS n, any_value(k2) AS k2, any_value(suffix_doubt) AS suffix_doubt, (sum(bad) + any_value(k2) * any_value(suffix_mean)) / (sum(n) + any_value(k2)) AS m FROM known JOIN su USING (suffix), k GROUP BY domain)),
    x AS (SELECT p.*, coalesce(known.bad, 0) AS bad, coalesce(known.n, 0) AS n, coalesce(domain_mean, suffix_mean, overall) AS prior, coalesce(domain_doubt, suffix_doubt, 0) AS doubt, k3, overall FROM p LEFT JOIN known USING (host)
        LEFT JOIN dom ON dom.domain = regexp_extract(p.host, '(?:[^.]*\\.)?[^.]*$') LEFT JOIN su ON su.suffix = regexp_extract(p.host, '[^.]*$'), k),
    y AS (SELECT *, (bad + k3 * prior) / (n + k3) AS m FROM x)
    SELECT page_id, host, path, {rule} AS rule, coalesce({said}, CASE WHEN m - {p.z} * sqrt(m * (1 - m) / (n + k3 + 1) + (k3 / (n + k3)) * (k3 / (n + k3)) * doubt) > {p.times_overall} * overall THEN 'block' ELSE 'allow' END) AS verdict FROM y"""
