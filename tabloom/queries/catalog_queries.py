"""Relational operators over the key catalog: REL1 to REL32."""

from __future__ import annotations

from tabloom.functions.prng import SPARK
from tabloom.queries.common import both
from tabloom.sources.catalog import with_catalog


def _arrays(d: str) -> dict[str, str]:
    """Where the dialects differ."""
    if d == SPARK:
        return {
            "pairs": "lateral view inline(arrays_zip(key, refkey)) p as k, rk",
            "keys": "lateral view posexplode(key) p as i, k",
            "has": "array_contains(key, num)",
            "pos": "cast(array_position(key, num) as bigint)",
            "at": "element_at(refkey, cast(array_position(key, num) as int))",
            "size": "size(key)",
            "agg": "listagg({x}, ', ') within group (order by {o})",
            "dagg": "array_join(array_sort(collect_set({x})), ', ')",
        }
    return {
        "pairs": ", (select unnest(key) as k, unnest(refkey) as rk) p",
        "keys": ", (select unnest(range(0, len(key))) as i, unnest(key) as k) p",
        "has": "list_contains(key, num)",
        "pos": "cast(list_position(key, num) as bigint)",
        "at": "refkey[list_position(key, num)]",
        "size": "len(key)",
        "agg": "string_agg({x}, ', ' order by {o})",
        "dagg": "string_agg(distinct {x}, ', ' order by {x})",
    }


def q(body: str):
    def make(d: str) -> str:
        a = _arrays(d)
        text = body
        for name in ("agg", "dagg"):
            while f"<{name} " in text:
                head, _, rest = text.partition(f"<{name} ")
                inner, _, tail = rest.partition(">")
                x, _, o = inner.partition(" | ")
                text = head + a[name].replace("{x}", x).replace("{o}", o) + tail
        for name, sql in a.items():
            text = text.replace(f"<{name}>", sql)
        return with_catalog(d, text)

    return both(make)


FLAGS = "select att.tab, att.col, att.num, con.name, con.kind, con.key, con.refkey, con.ref from att join con on att.tab = con.tab and <has>"
PAIRS = "select name, tab, ref, k, rk from con <pairs> where kind = 'f'"
KEYS = "select name, tab, kind, i, k from con <keys>"

ALL = {
    "rel1_cte_chain": q(f", flags as ({FLAGS}), pk as (select tab, col from flags where kind = 'p'), fk as (select tab, col from flags where kind = 'f') select att.tab, att.col, pk.col is not null as is_pk, fk.col is not null as is_fk from att left join pk on att.tab = pk.tab and att.col = pk.col left join (select distinct tab, col from fk) fk on att.tab = fk.tab and att.col = fk.col"),
    "rel2_projection": q("select tab, col, cast(num as bigint) as num from att"),
    "rel3_filter": q("select tab, col from att where num > 1 and typ = 'text' and tab not in ('documents', 'part') and not (col like '%name')"),
    "rel4_in_list": q("select tab, col, typ from att where tab in ('orders', 'customer')"),
    "rel5_fk_join": q(f", p as ({PAIRS}) select p.name, p.tab, a.col, p.ref, b.col as refcol from p join att a on a.tab = p.tab and a.num = p.k join att b on b.tab = p.ref and b.num = p.rk"),
    "rel6_left_join": q("select att.tab, att.col, e.ref from att left join edge e on att.tab = e.tab and att.col = e.col"),
    "rel7_multi_key": q("select a.tab, a.col, e.ref, e.refcol from edge e join att a on a.tab = e.tab and a.col = e.col join att b on b.tab = e.ref and b.col = e.refcol"),
    "rel8_any_join": q("select att.tab, att.col, con.name from att join con on att.tab = con.tab and <has>"),
    "rel9_unnest_pairs": q(PAIRS),
    "rel10_ordinality": q(f", k as ({KEYS}) select k.name, cast(k.i + 1 as bigint) as ord, att.col from k join att on att.tab = k.tab and att.num = k.k"),
    "rel11_string_agg": q(f", k as ({KEYS}), c as (select k.name, k.kind, k.i, concat('public.', att.tab, '.', att.col) as col from k join att on att.tab = k.tab and att.num = k.k) select name, kind, <agg col | i> as columns from c group by name, kind"),
    "rel12_incoming": q("select ref, refcol, <agg concat(tab, '.', col) | tab, col> as incoming from (select *, 1 as one from edge) e group by ref, refcol"),
    "rel13_distinct_agg": q(f", k as ({KEYS}), peers as (select a.tab, a.k, b.k as peer from k a join k b on a.name = b.name and a.k <> b.k) select p.tab, p.k, <dagg att.col> as peers from peers p join att on att.tab = p.tab and att.num = p.peer group by p.tab, p.k"),
    "rel14_group_by": q("select tab, kind, count(*) as n from con group by tab, kind"),
    "rel15_bool_or": q(f", flags as ({FLAGS}) select tab, col, bool_or(kind = 'p') as is_pk, bool_or(kind = 'u') as is_unique, bool_or(kind = 'f') as is_fk from flags group by tab, col"),
    "rel17_scalar_count": q("select att.tab, att.col, (select count(*) from edge e where e.ref = att.tab and e.refcol = att.col) as referenced from att"),
    "rel19_case": q("select name, case kind when 'p' then 'PRIMARY KEY' when 'u' then 'UNIQUE' when 'f' then 'FOREIGN KEY' else 'CHECK' end as type from con"),
    "rel20_array_pick": q("select tab, col, case when typ like '%[]' then 'elements' else 'values' end as picked, replace(typ, '[]', '') as base from att"),
    "rel21_concat_flags": q(f", flags as ({FLAGS}), f as (select tab, col, bool_or(kind = 'p') as p, bool_or(kind = 'f') as f, bool_or(kind = 'u') as u from flags group by tab, col) select tab, col, trim(concat(case when p then 'PK ' else '' end, case when f then 'FK ' else '' end, case when u then 'UNIQUE ' else '' end)) as flags from f"),
    "rel22_null_percent": q("select tab, col, cast(round(cast(num as decimal(10, 4)) / 7 * 100, 2) as double) as percent from att"),
    "rel23_order_by": q("select tab, num, col, row_number() over (order by tab, num desc) as place from att order by tab, num desc"),
    "rel24_composites": q("select name, tab, cast(<size> as bigint) as width from con where <size> > 1"),
    "rel25_peers": q(f", k as ({KEYS}) select a.name, a.tab, a.k as own, b.k as peer from k a join k b on a.name = b.name and a.k <> b.k"),
    "rel26_row_in": q("select tab, col, typ from att where (tab, col) in (select ref, refcol from edge)"),
    "rel27_coalesce_distinct": q("select distinct coalesce(ref, tab) as owner from con"),
    "rel28_array_position": q(f", flags as ({FLAGS}) select name, tab, col, <pos> as place, <at> as target from flags where kind = 'f'"),
    "rel29_limit_one": q("select att.tab, att.col, (select min(e.ref) from edge e where e.tab = att.tab and e.col = att.col) as first_ref from att"),
    "rel30_scalars": q("select tab, col, nullif(trim(concat(' ', typ, ' ')), 'text') as typ, coalesce(nullif(tab, 'labels'), 'none') as tab_or_none from att"),
    "rel32_anti": q("select idx.tab, idx.name from idx left join con on con.tab = idx.tab and con.name = idx.name where con.name is null"),
}

_TREE = "with recursive edge as {edge}, tree(tab, anc, depth) as (select tab, ref, 1 from edge union all select t.tab, e.ref, t.depth + 1 from tree t join edge e on e.tab = t.anc) select distinct tab, anc, depth from tree"


def _tree(d: str) -> str:
    from tabloom.sources.catalog import relation

    return _TREE.replace("{edge}", relation(d, "edge"))


ALL["rel31_recursive"] = both(_tree)


def _first_index(body: str):
    """Array subscripts begin at 0 in one dialect, at 1 in the other."""

    def make(d: str) -> str:
        a = _arrays(d)
        text = body.replace("idx.key[<one>]", "element_at(idx.key, 1)" if d == SPARK else "idx.key[1]")
        for name, sql in a.items():
            text = text.replace(f"<{name}>", sql)
        return with_catalog(d, text)

    return both(make)


ALL["rel16_exists"] = _first_index("select tab, col from att where exists (select 1 from idx where idx.tab = att.tab and idx.uniq and idx.key[<one>] = att.num and <size> = 1)")
ALL["rel18_union_peers"] = _first_index(f", k as ({KEYS}), u as (select tab, k, name from k where kind in ('p', 'u') union all select idx.tab, idx.key[<one>] as k, idx.name from idx where idx.uniq) select tab, k, count(*) as n from u group by tab, k")
Q = {n: run for n, (run, _) in ALL.items()}
O = {n: sql for n, (_, sql) in ALL.items()}
