"""DuckDB SQL for the registered queries, written from the formulas and apart from the Spark code."""

from __future__ import annotations

CEIL = "0.999999"
R = range(10)

LOG = """WITH s AS (SELECT o_orderkey AS serp_id, CAST(o_custkey % 40 AS INT) AS query_id FROM orders),
ck AS (SELECT DISTINCT l_orderkey AS serp_id, l_linenumber - 1 AS rank FROM lineitem WHERE l_returnflag = 'R'),
imp AS (SELECT s.serp_id, s.query_id, CAST(r.rank AS INT) AS rank, CAST((s.query_id * 7 + r.rank * 3 + s.serp_id % 4) % 50 AS INT) AS doc_id,
  CASE WHEN ck.rank IS NULL THEN 0 ELSE 1 END AS click
  FROM s CROSS JOIN (SELECT unnest(range(10)) AS rank) r LEFT JOIN ck ON ck.serp_id = s.serp_id AND ck.rank = r.rank)"""
SPARSE = LOG.replace("% 40 AS INT", "% 1500 AS INT").replace("s.serp_id % 4) % 50", "(s.serp_id % 16) * 9) % 5000")
SPLIT = """,
cut AS (SELECT serp_id, row_number() OVER (ORDER BY serp_id) <= CAST(floor(count(*) OVER () * 0.8 - 0.5) AS BIGINT) + 1 AS is_train FROM s),
train AS (SELECT imp.* FROM imp JOIN cut USING (serp_id) WHERE is_train),
test0 AS (SELECT imp.* FROM imp JOIN cut USING (serp_id) WHERE NOT is_train),
seen AS (SELECT DISTINCT query_id, doc_id FROM train),
good AS (SELECT DISTINCT serp_id FROM test0 JOIN seen USING (query_id, doc_id)),
test AS (SELECT test0.* FROM test0 JOIN good USING (serp_id))"""
PREV = """,
cells AS (SELECT *, coalesce(max(CASE WHEN click = 1 THEN rank END) OVER (PARTITION BY serp_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS prev FROM {0}),
slots AS (SELECT *, CAST(rank * (rank + 1) // 2 + prev AS INT) AS slot FROM cells)"""

RUNS = """WITH x AS (SELECT *, CAST(floor(abs(s_acctbal)) AS BIGINT) AS x FROM supplier),
runs AS (SELECT s_suppkey % 4 AS model, 'GPU ' || (s_nationkey % 3) AS device, [1, 2, 4][s_suppkey % 3 + 1] AS nodes, s_suppkey // 4 % 2 * 1000 + 1000 AS sessions,
x::DOUBLE AS training_time, x + 1.0::DOUBLE AS iteration_time, x % 100 + 1.0::DOUBLE AS computation_time, 1 + (x % 1000) / 1000.0 AS perplexity FROM x)"""
TRACE = "WITH trace AS (SELECT event_id * 10 AS time, event_type AS kind, value AS busy FROM events)"


def clamp(x: str) -> str:
    return f"(CASE WHEN {x} < {CEIL} THEN {x} ELSE {CEIL} END)"


def value(num: str, n: str) -> str:
    return clamp(f"((1 + {num}) / (2.0 + {n}))")


def pbm(source: str, k: int) -> str:
    sql = f""",
a0 AS (SELECT DISTINCT query_id, doc_id, 0.5::DOUBLE AS v FROM {source}),
g0 AS (SELECT CAST(unnest(range(10)) AS INT) AS rank, 0.5::DOUBLE AS v)"""
    for i in range(1, k + 1):
        sql += f""",
e{i} AS (SELECT t.query_id, t.doc_id, t.rank, t.click, a.v AS a, g.v AS g FROM {source} t JOIN a{i - 1} a USING (query_id, doc_id) JOIN g{i - 1} g ON g.rank = t.rank),
a{i} AS (SELECT query_id, doc_id, {value("sum(CASE WHEN click = 1 THEN 1 ELSE (a - a * g) / (1 - a * g) END)", "count(*)")} AS v FROM e{i} GROUP BY ALL),
g{i} AS (SELECT rank, {value("sum(CASE WHEN click = 1 THEN 1 ELSE (g - a * g) / (1 - a * g) END)", "count(*)")} AS v FROM e{i} GROUP BY ALL)"""
    return sql


def ubm(source: str, k: int, prior: bool = False, exact: bool = False) -> str:
    sql = (
        PREV.format(source).replace("rank * (rank + 1) // 2 + prev", "rank * 10 + prev" if exact else "rank * (rank + 1) // 2 + prev")
        + f""",
pages AS (SELECT count(DISTINCT serp_id) AS n FROM {source}),
a0 AS (SELECT DISTINCT query_id, doc_id, 0.5::DOUBLE AS v FROM {source}),
g0 AS (SELECT CAST(unnest(range({100 if exact else 55})) AS INT) AS slot, 0.5::DOUBLE AS v)"""
    )
    extra = lambda x: f" + (SELECT n FROM pages) * {x} - count(k) * {x}" if prior else ""
    for i in range(1, k + 1):
        sql += f""",
e{i} AS (SELECT t.serp_id, t.query_id, t.doc_id, t.rank, t.slot, t.click, a.v AS a, g.v AS g FROM slots t JOIN a{i - 1} a USING (query_id, doc_id) JOIN g{i - 1} g ON g.slot = t.slot),
a{i} AS (SELECT query_id, doc_id, {value("sum(CASE WHEN click = 1 THEN 1 ELSE (a - a * g) / (1 - a * g) END)", "count(*)")} AS v FROM e{i} GROUP BY ALL),
k{i} AS (SELECT slot, CASE WHEN click = 1 THEN 1 ELSE (g - a * g) / (1 - a * g) END AS k FROM e{i} QUALIFY row_number() OVER (PARTITION BY serp_id, slot ORDER BY rank DESC) = 1),
g{i} AS (SELECT z.slot, {value(f"coalesce(sum(k), 0){extra(1)}", f"count(k){extra(2)}")} AS v FROM g0 z LEFT JOIN k{i} USING (slot) GROUP BY z.slot)"""
    return sql


def wide(source: str, a: str | None, s: str | None) -> str:
    """One row a page: q, d0.., c0.., a0.., s0.. with 0.5 where a table has no value."""
    pick = lambda c, x: ", ".join(f"max(CASE WHEN t.rank = {r} THEN {x} END) AS {c}{r}" for r in R)
    va, vs = ("coalesce(a.v, 0.5)" if a else "0.5::DOUBLE"), ("coalesce(z.v, 0.5)" if s else "0.5::DOUBLE")
    joins = (f" LEFT JOIN {a} a ON a.query_id = t.query_id AND a.doc_id = t.doc_id" if a else "") + (f" LEFT JOIN {s} z ON z.query_id = t.query_id AND z.doc_id = t.doc_id" if s else "")
    return f"SELECT t.serp_id, t.query_id AS q, {pick('d', 't.doc_id')}, {pick('c', 't.click')}, {pick('a', va)}, {pick('s', vs)} FROM {source} t{joins} GROUP BY t.serp_id, t.query_id"


def nested(levels: list[list[str]], source: str) -> str:
    """SELECTs in each other, as a column may use those of earlier levels alone."""
    sql = f"SELECT * FROM {source}"
    for columns in levels:
        sql = f"SELECT *, {', '.join(columns)} FROM ({sql})"
    return sql


class Cascade:
    """SQL of CCM or DBN with the public values in columns t1, t2, t3 (DBN: t1)."""

    def __init__(self, kind: str, prior: bool = False):
        self.kind, self.n, self.prior = kind, 3 if kind == "ccm" else 1, int(prior)

    def after(self, r: int) -> str:
        return f"(t2 * (1 - a{r}) + t3 * a{r})" if self.kind == "ccm" else f"(t1 * (1 - s{r}))"

    def step(self, r: int) -> str:
        return f"((1 - a{r}) * t1 + a{r} * ((1 - a{r}) * t2 + a{r} * t3))" if self.kind == "ccm" else f"(t1 * (1 - a{r}) + t1 * a{r} * (1 - s{r}))"

    def levels(self, starts: range) -> list[list[str]]:
        """Columns p{s}_{i} and x{s}_{i} (flags from rank s on, parameters from rank 0 on), examination m0.. and
        chance of a click from a rank on k0.., in groups that need earlier groups alone."""
        out = [[f"1::DOUBLE AS x{s}_0" for s in starts] + ["1::DOUBLE AS m0", "0::DOUBLE AS k10"]]
        for i in R:
            now = [s for s in starts if i < 10 - s]
            hit = [f"CASE WHEN c{s + i} = 1 THEN a{i} * x{s}_{i} ELSE 1 - a{i} * x{s}_{i} END AS p{s}_{i}" for s in now]
            out.append([*hit, f"a{9 - i} + (1 - a{9 - i}) * t1 * k{10 - i} AS k{9 - i}", f"m{i} * {self.step(i)} AS m{i + 1}"])
            out.append([f"CASE WHEN c{s + i} = 1 THEN {self.after(i)} ELSE x{s}_{i} * t1 * (1 - a{i}) / p{s}_{i} END AS x{s}_{i + 1}" for s in now])
        return out

    def walk(self) -> list[list[str]]:
        """All starts, the last click and the tails tail0..tail9."""
        last = "CASE " + " ".join(f"WHEN c{r} = 1 THEN {r}" for r in reversed(R)) + " ELSE 10 END AS last_rank"
        tails = [" * ".join(f"p{r + 1}_{i}" for i in range(9 - r)) + f" AS tail{r}" for r in range(9)]
        return [*self.levels(R), [last, *tails, "1::DOUBLE AS tail9"]]

    def terms(self) -> list[str]:
        """For each rank: attractiveness (an, ad), satisfaction (sn, sd), public (n1, e1, ...)."""
        out = []
        for r in R:
            e = f"(CASE WHEN {r} >= last_rank THEN 1 ELSE 0 END)"
            x, t, a, s = f"x0_{r}", f"tail{r}", f"a{r}", f"s{r}"
            miss = f"CASE WHEN {r} >= last_rank THEN (1 - m{r}) * {a} / (1 - m{r} * k{r}) ELSE 0 END"
            if self.kind == "ccm":
                again = f"CASE WHEN {r} = last_rank THEN {a} / (1 - {self.after(r)} * k{r + 1}) ELSE 0 END"
                out += [f"CASE WHEN c{r} = 1 THEN 1 + {again} ELSE {miss} END AS an{r}", f"1 + c{r} AS ad{r}"]
                d1 = f"(t1 * {t} * {x} + (1 - t1) * {x} * {e} + (1 - {x}) * {e})"
                d2 = f"((1 - {a}) * (t2 * {t} + (1 - t2) * {e}) + {a} * (t3 * {t} + (1 - t3) * {e}))"
                out += [
                    f"CASE WHEN c{r} = 0 THEN t1 * {t} * {x} / {d1} ELSE 0 END AS n1_{r}",
                    f"CASE WHEN c{r} = 0 THEN (t1 * {t} * {x} + (1 - t1) * {x} * {e}) / {d1} ELSE 0 END AS e1_{r}",
                    f"CASE WHEN c{r} = 1 THEN (1 - {a}) * t2 * {t} / {d2} ELSE 0 END AS n2_{r}",
                    f"CASE WHEN c{r} = 1 THEN (1 - {a}) * (t2 * {t} + (1 - t2) * {e}) / {d2} ELSE 0 END AS e2_{r}",
                    f"CASE WHEN c{r} = 1 THEN {a} * t3 * {t} / {d2} ELSE 0 END AS n3_{r}",
                    f"CASE WHEN c{r} = 1 THEN {a} * (t3 * {t} + (1 - t3) * {e}) / {d2} ELSE 0 END AS e3_{r}",
                ]
            else:
                out += [f"CASE WHEN c{r} = 1 THEN 1 ELSE {miss} END AS an{r}", f"1 AS ad{r}"]
                out += [f"CASE WHEN {r} = last_rank THEN {s} / (1 - (1 - {s}) * t1 * k{r + 1}) ELSE 0 END + {self.prior} * (1 - c{r}) AS sn{r}", f"c{r} + {2 * self.prior} * (1 - c{r}) AS sd{r}"]
                d0 = f"(t1 * {t} * {x} + (1 - t1) * {x} * {e} + (1 - {x}) * {e})"
                d1 = f"((1 - {s}) * (t1 * {t} + (1 - t1) * {e}) + {s} * {e})"
                out += [
                    f"CASE WHEN c{r} = 1 THEN (1 - {s}) * t1 * {t} / {d1} ELSE t1 * {t} * {x} / {d0} END AS n1_{r}",
                    f"CASE WHEN c{r} = 1 THEN (1 - {s}) * (t1 * {t} + (1 - t1) * {e}) / {d1} ELSE (t1 * {t} * {x} + (1 - t1) * {x} * {e}) / {d0} END AS e1_{r}",
                ]
        return out

    def fit(self, source: str, k: int) -> str:
        pub = ", ".join(f"0.5::DOUBLE AS t{j + 1}" for j in range(self.n))
        sql = f",\ng0 AS (SELECT {pub})"
        for i in range(1, k + 1):
            a, s = (f"a{i - 1}", f"s{i - 1}" if self.kind == "dbn" else None) if i > 1 else (None, None)
            sql += f",\nw{i} AS ({wide(source, a, s)}),\nv{i} AS ({nested(self.walk(), f"w{i} CROSS JOIN g{i - 1}")}),\nu{i} AS (SELECT *, {', '.join(self.terms())} FROM v{i})"
            rows = lambda n, d, w="TRUE": " UNION ALL ".join(f"SELECT q, d{r} AS d, {n}{r} AS x, {d}{r} AS y FROM u{i} WHERE {w.format(r)}" for r in R)
            sql += f",\na{i} AS (SELECT q AS query_id, d AS doc_id, {clamp('((1 + sum(x)) / (2.0 + sum(y)))')} AS v FROM ({rows('an', 'ad')}) GROUP BY 1, 2)"
            if self.kind == "dbn":
                sql += f",\ns{i} AS (SELECT q AS query_id, d AS doc_id, {clamp('((1 + sum(x)) / (2.0 + sum(y)))')} AS v FROM ({rows('sn', 'sd')}) GROUP BY 1, 2)"
            total = lambda c, j: " + ".join(f"sum({c}{j}_{r})" for r in R)
            pub = ", ".join(f"{clamp(f'((1 + {total("n", j)}) / (2.0 + {total("e", j)}))')} AS t{j}" for j in range(1, self.n + 1))
            sql += f",\ng{i} AS (SELECT {pub} FROM u{i})"
        return sql

    def scored(self, source: str, k: int) -> str:
        """Rows (serp_id, rank, p, f): conditional and full probabilities of the flags."""
        full = lambda r: f"CASE WHEN c{r} = 1 THEN a{r} * m{r} ELSE 1 - a{r} * m{r} END"
        rows = " UNION ALL ".join(f"SELECT serp_id, {r} AS rank, p0_{r} AS p, {full(r)} AS f FROM tv" for r in R)
        s = f"s{k}" if self.kind == "dbn" else None
        return f",\ntw AS ({wide(source, f'a{k}', s)}),\ntv AS ({nested(self.levels(range(1)), f"tw CROSS JOIN g{k}")}),\nscored AS ({rows})"


def pbm_scored(source: str, k: int) -> str:
    return f""",
tv AS (SELECT t.serp_id, t.rank, t.click, coalesce(a.v, 0.5) * g.v AS y FROM {source} t LEFT JOIN a{k} a USING (query_id, doc_id) JOIN g{k} g ON g.rank = t.rank),
scored AS (SELECT serp_id, rank, CASE WHEN click = 1 THEN y ELSE 1 - y END AS p, CASE WHEN click = 1 THEN y ELSE 1 - y END AS f FROM tv)"""


def ubm_scored(source: str, k: int) -> str:
    """Full probabilities marginalise over the previous click: F_r = sum over j of F_j * no click between * click at r."""
    slot = lambda r, p: r * (r + 1) // 2 + p
    g = lambda r, p: f"g[{slot(r, p) + 1}]"
    columns = []
    for r in R:
        parts = []
        for j in range(-1, r):
            p = 9 if j < 0 else j
            between = "".join(f" * (1 - a{n} * {g(n, p)})" for n in range(j + 1, r))
            parts.append(("1" if j < 0 else f"f{j}") + between + f" * a{r} * {g(r, p)}")
        columns.append(" + ".join(parts) + f" AS f{r}")
    rows = " UNION ALL ".join(f"SELECT serp_id, {r} AS rank, CASE WHEN c{r} = 1 THEN f{r} ELSE 1 - f{r} END AS f FROM tf" for r in R)
    return f""",
tw AS ({wide(source, f"a{k}", None)}),
gl AS (SELECT list(v ORDER BY slot) AS g FROM g{k}),
tf AS ({nested([[c] for c in columns], "tw CROSS JOIN gl")}),
fl AS ({rows}),
tc AS (SELECT *, coalesce(max(CASE WHEN click = 1 THEN rank END) OVER (PARTITION BY serp_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS prev FROM {source}),
cl AS (SELECT t.serp_id, t.rank, CASE WHEN t.click = 1 THEN coalesce(a.v, 0.5) * g.v ELSE 1 - coalesce(a.v, 0.5) * g.v END AS p
  FROM tc t LEFT JOIN a{k} a USING (query_id, doc_id) JOIN g{k} g ON g.slot = t.rank * (t.rank + 1) // 2 + t.prev),
scored AS (SELECT cl.serp_id, cl.rank, cl.p, fl.f FROM cl JOIN fl USING (serp_id, rank))"""


LLH = "SELECT round(sum(ln(p)) / count(*), 6) AS log_likelihood, count(DISTINCT serp_id) AS n_serps FROM scored"
BY_RANK = "SELECT rank, round(pow(2, -avg(log2(f))), 6) AS perplexity FROM scored GROUP BY rank"
OVERALL = "SELECT round(avg(x), 6) AS perplexity FROM (SELECT pow(2, -avg(log2(f))) AS x FROM scored GROUP BY rank)"


def fitted(model: str, source: str, k: int) -> str:
    return pbm(source, k) if model == "pbm" else ubm(source, k) if model == "ubm" else Cascade(model).fit(source, k)


def scored(model: str, source: str, k: int) -> str:
    return pbm_scored(source, k) if model == "pbm" else ubm_scored(source, k) if model == "ubm" else Cascade(model).scored(source, k)


def oracle_sql() -> dict[str, str]:
    atr = "SELECT query_id, doc_id, round(v, 6) AS value FROM {}"
    out = {
        "click_log": LOG + " SELECT serp_id, query_id, rank, doc_id, click FROM imp",
        "serp_last_click": LOG + " SELECT serp_id, coalesce(max(CASE WHEN click = 1 THEN rank END), 10) AS last_click FROM imp GROUP BY serp_id",
        "serp_prev_click": LOG + PREV.format("imp") + " SELECT serp_id, rank, prev AS previous FROM slots",
        "ubm_slots": LOG + PREV.format("imp") + " SELECT slot, count(*) AS n FROM slots GROUP BY slot",
        "train_test_counts": LOG + SPLIT + " SELECT count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test FROM cut",
        "test_filtered": SPARSE + SPLIT + " SELECT serp_id, query_id FROM test GROUP BY ALL",
        "test_dropped": SPARSE + SPLIT + " SELECT serp_id, query_id FROM test0 WHERE serp_id NOT IN (SELECT serp_id FROM good) GROUP BY ALL",
        "qd_dictionary_size": SPARSE + SPLIT + " SELECT count(*) AS n_qd FROM seen",
        "bucket_stats": LOG + SPLIT + """ SELECT b.bucket, n_train, n_test, n_pairs FROM
(SELECT query_id % 8 AS bucket, count(DISTINCT serp_id) AS n_train FROM train GROUP BY 1) b
JOIN (SELECT query_id % 8 AS bucket, count(DISTINCT serp_id) AS n_test FROM test GROUP BY 1) t USING (bucket)
JOIN (SELECT query_id % 8 AS bucket, count(*) AS n_pairs FROM seen GROUP BY 1) p USING (bucket)""",
        "pbm_estep_once": LOG + pbm("imp", 1) + " SELECT rank, round(sum(CASE WHEN click = 1 THEN 1 ELSE (g - a * g) / (1 - a * g) END), 4) AS num, count(*) AS den FROM e1 GROUP BY rank",
        "pbm_attractiveness_3": LOG + pbm("imp", 3) + " " + atr.format("a3"),
        "pbm_examination_3": LOG + pbm("imp", 3) + " SELECT rank AS slot, round(v, 6) AS value FROM g3",
        "pbm_predict": LOG + SPLIT + pbm("train", 2) + pbm_scored("test", 2) + " SELECT serp_id, rank, round(y, 6) AS p FROM tv",
        "ubm_attractiveness_3": LOG + ubm("imp", 3) + " " + atr.format("a3"),
        "ubm_examination_3": LOG + ubm("imp", 3) + " SELECT slot, round(v, 6) AS value FROM g3",
        "ubm_examination_prior_unset": LOG + ubm("imp", 2, prior=True) + " SELECT slot, round(v, 6) AS value FROM g2",
        "ubm_full_probs": LOG + SPLIT + ubm("train", 2) + ubm_scored("test", 2) + " SELECT serp_id, rank, round(f, 6) AS p FROM scored",
        "export_examination": LOG + pbm("imp", 2) + " SELECT rank, printf('%.6f', v) AS examination FROM g2",
        "export_attractiveness": LOG + pbm("imp", 2) + " SELECT query_id AS query, doc_id AS document, printf('%.6f', v) AS attractiveness FROM a2",
        "malformed_rows": """SELECT CASE p_partkey % 7 WHEN 0 THEN 'first token is no number' WHEN 1 THEN 'number of tokens' ELSE 'a token is no number' END AS reason,
count(*) AS n FROM part WHERE p_partkey % 7 < 3 GROUP BY 1""",
        "text_log_round_trip": LOG + " SELECT serp_id + 1 AS serp_id, query_id, rank, doc_id, click FROM imp WHERE serp_id < (SELECT max(serp_id) FROM s)",
    }
    for m in ("ccm", "dbn"):
        c = Cascade(m)
        once = LOG + c.fit("imp", 1)
        rows = lambda x: " UNION ALL ".join(f"SELECT serp_id, {r} AS rank, {x(r)} FROM v1" for r in R)
        out[f"{m}_exam_car"] = once + " " + rows(lambda r: f"round(m{r}, 6) AS exam, round(k{r}, 6) AS car")
        out[f"{m}_tail"] = once + " " + rows(lambda r: f"round(ln(tail{r}), 6) AS log_tail")
        out[f"{m}_attractiveness_2"] = LOG + c.fit("imp", 2) + " " + atr.format("a2")
        public = " UNION ALL ".join(f"SELECT {j} AS slot, round(t{j + 1}, 6) AS value FROM g2" for j in range(c.n))
        out["ccm_tau_2" if m == "ccm" else "dbn_gamma_2"] = LOG + c.fit("imp", 2) + " " + public
    out["ccm_tau_1iter"] = LOG + Cascade("ccm").fit("imp", 1) + " " + " UNION ALL ".join(f"SELECT {j} AS slot, round(t{j + 1}, 6) AS value FROM g1" for j in range(3))
    out["dbn_satisfaction_2"] = LOG + Cascade("dbn").fit("imp", 2) + " " + atr.format("s2")
    for m in ("pbm", "ubm", "ccm", "dbn"):
        head = LOG + SPLIT + fitted(m, "train", 2) + scored(m, "test", 2)
        out[f"{m}_llh"] = f"{head} {LLH}"
        out[f"{m}_perplexity_by_rank"] = f"{head} {BY_RANK}"
        out[f"{m}_perplexity"] = f"{head} {OVERALL}"
    chance = "SELECT serp_id, rank, round(CASE WHEN click = 1 THEN p ELSE 1 - p END, 6) AS p FROM scored JOIN test USING (serp_id, rank)"
    shown = "SELECT serp_id, rank, round(p, 6) AS p FROM scored"
    out |= {
        "limited_sessions": LOG + " SELECT serp_id + 1 AS serp_id, query_id, rank, doc_id, click FROM imp WHERE serp_id < 1000",
        "leading_clicks": LOG + " SELECT serp_id - 99 AS serp_id, query_id, rank, doc_id, click FROM imp WHERE serp_id >= 100 AND serp_id < (SELECT max(serp_id) FROM s)",
        "split_by_bucket": LOG + """,
b AS (SELECT query_id % 8 AS bucket, serp_id, row_number() OVER (PARTITION BY query_id % 8 ORDER BY serp_id) <=
  CAST(floor(count(*) OVER (PARTITION BY query_id % 8) * 0.8 - 0.5) AS BIGINT) + 1 AS is_train FROM s)
SELECT bucket, count(*) FILTER (is_train) AS n_train, count(*) FILTER (NOT is_train) AS n_test, max(serp_id) FILTER (is_train) AS last_train FROM b GROUP BY bucket""",
        "export_per_impression": LOG + pbm("imp", 2) + " SELECT query_id AS query, doc_id AS document, printf('%.6f', v) AS attractiveness FROM imp JOIN a2 USING (query_id, doc_id)",
        "export_satisfaction": LOG + Cascade("dbn").fit("imp", 2) + " SELECT query_id AS query, doc_id AS document, printf('%.6f', v) AS satisfaction FROM s2",
        "metrics_report": LOG + SPLIT + pbm("train", 2) + pbm_scored("test", 2) + f""" SELECT 'log likelihood' AS metric, round(sum(ln(p)) / count(*), 6) AS value FROM scored
UNION ALL SELECT 'perplexity', perplexity FROM ({OVERALL}) UNION ALL SELECT 'perplexity at rank ' || rank, perplexity FROM ({BY_RANK})""",
        "ubm_examination_exact": LOG + ubm("imp", 2, exact=True) + " SELECT slot, round(v, 6) AS value FROM g2",
        "dbn_satisfaction_prior_unset": LOG + Cascade("dbn", prior=True).fit("imp", 2) + " " + atr.format("s2"),
        "ubm_predict": LOG + SPLIT + ubm("train", 2) + ubm_scored("test", 2) + " " + chance,
        "ccm_predict": LOG + SPLIT + fitted("ccm", "train", 2) + scored("ccm", "test", 2) + " " + shown,
        "dbn_predict": LOG + SPLIT + fitted("dbn", "train", 2) + scored("dbn", "test", 2) + " " + shown,
        "pbm_predict_unseen": SPARSE + SPLIT + pbm("train", 2) + pbm_scored("test", 2) + " " + chance,
        "dbn_predict_unseen": SPARSE + SPLIT + fitted("dbn", "train", 2) + scored("dbn", "test", 2) + " " + shown,
        "gzip_log_round_trip": out["text_log_round_trip"],
        "read_counts": LOG + """ SELECT p.n + i.pages + i.clicks AS n_lines, i.pages AS n_queries, i.clicks + p.n - p.bad AS n_clicks, p.bad AS n_rejected
FROM (SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 < 3) AS bad FROM part) p, (SELECT count(DISTINCT serp_id) AS pages, CAST(sum(click) AS BIGINT) AS clicks FROM imp) i""",
        "dense_ids": SPARSE + SPLIT + " SELECT query_id, doc_id, row_number() OVER (ORDER BY min(serp_id * 10 + rank)) - 1 AS id FROM train GROUP BY query_id, doc_id",
        "pbm_reloaded": LOG + pbm("imp", 3) + " " + atr.format("a3"),
        "dbn_reloaded": LOG + Cascade("dbn").fit("imp", 2) + " " + atr.format("s2"),
        "parameters_replaced": LOG + pbm("imp", 3) + """,
y AS (SELECT serp_id, click, a.v * g.v AS y FROM imp JOIN a3 a USING (query_id, doc_id) JOIN g1 g ON g.rank = imp.rank)
SELECT round(avg(ln(CASE WHEN click = 1 THEN y ELSE 1 - y END)), 6) AS log_likelihood, count(DISTINCT serp_id) AS n_serps FROM y""",
        "pbm_resumed": out["pbm_examination_3"],
        "ccm_resumed": out["ccm_tau_2"],
        "ubm_replicas": out["ubm_attractiveness_3"],
        "ccm_replicas": out["ccm_tau_2"],
        "pbm_merged": LOG + pbm("imp", 1) + " " + atr.format("a1"),
        "export_in_order": LOG + pbm("imp", 2) + """ SELECT 0 AS place, 'query, document, attractiveness' AS row
UNION ALL SELECT row_number() OVER (ORDER BY serp_id, rank), query_id || ', ' || doc_id || ', ' || printf('%.6f', v) FROM imp JOIN a2 USING (query_id, doc_id)""",
        "cli_report": LOG.replace("FROM orders)", "FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders))") + SPLIT + pbm("train", 2) + pbm_scored("test", 2) + f""" SELECT 'log likelihood' AS metric, round(sum(ln(p)) / count(*), 6) AS value FROM scored
UNION ALL SELECT 'perplexity', perplexity FROM ({OVERALL}) UNION ALL SELECT 'perplexity at rank ' || rank, perplexity FROM ({BY_RANK})
UNION ALL SELECT 'examination ' || rank, round(v, 6) FROM g2""",
        "run_logs": RUNS + " SELECT model, device, nodes, sessions, 2 AS partitioning, training_time, iteration_time, computation_time, round(perplexity, 6) AS perplexity, NULL::DOUBLE AS evaluation_time FROM runs",
        "run_means": RUNS + " SELECT nodes, sessions, round(avg(training_time), 6) AS training_time FROM runs WHERE model = 1 AND device = 'GPU 1' GROUP BY ALL",
        "run_speedup": RUNS + """, base AS (SELECT sessions, avg(training_time) AS b FROM runs WHERE model = 0 GROUP BY sessions)
SELECT nodes, sessions, round(max(b) / avg(training_time), 6) AS speedup FROM runs JOIN base USING (sessions) WHERE model = 1 AND device = 'GPU 1' GROUP BY nodes, sessions""",
        "run_measures": RUNS + " SELECT model, round(100 * computation_time / iteration_time, 6) AS computation_percent, round(least(1.5, perplexity * 1.2), 6) AS attainable FROM runs",
        "trace_categories": "SELECT DISTINCT event_type AS kind FROM events",
        "trace_of_category": TRACE + " SELECT time - min(time) OVER () AS time, busy FROM trace WHERE kind = 'click'",
        "trace_rebased": TRACE + " SELECT time - min(time) OVER (PARTITION BY kind) AS time, kind, busy FROM trace",
    }
    parts = []
    for m in ("pbm", "ubm", "ccm", "dbn"):
        head = LOG + SPLIT + fitted(m, "train", 2) + scored(m, "test", 2)
        parts.append(f"SELECT '{m}' AS model, * FROM ({head} SELECT (SELECT round(sum(ln(p)) / count(*), 6) FROM scored) AS log_likelihood, ({OVERALL}) AS perplexity)")
    out["model_comparison"] = " UNION ALL ".join(parts)
    return out
