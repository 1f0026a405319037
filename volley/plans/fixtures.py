"""Spike trains, signals, masks and logs derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EPOCH = 1704067200000000
FS = 250_000.0

_SPARK = {
    "spikes_ev": f"select concat('P', cast(user_id % 3 as string)) port, user_id unit_id, cast(floor((unix_micros(cast(ts as timestamp)) - {EPOCH}) / 1000000) as bigint) sample_idx, max(value) height from events group by 1, 2, 3",
    "spikes_rec": f"select concat('R', cast(event_id % 2 as string)) recording_id, concat('P', cast(user_id % 3 as string)) port, user_id unit_id, cast(floor((unix_micros(cast(ts as timestamp)) - {EPOCH}) / 1000000) as bigint) sample_idx, max(value) height from events group by 1, 2, 3, 4",
    "samples_emb": "select cast(pos as int) channel, vec_id sample_idx, cast(x as double) x from embeddings lateral view posexplode(embedding) t as pos, x",
    "spikes_lab": "select cast(label as bigint) unit_id, vec_id sample_idx from embeddings",
    "force_hr": f"select 0 channel, cast(floor((unix_micros(cast(ts as timestamp)) - {EPOCH}) / 3600000000) as bigint) sample_idx, sum(value) x from events group by 1, 2",
    "masks": "select l_suppkey file_id, l_linenumber % 2 port, l_partkey % 64 channel, bool_or(l_returnflag = 'R' and l_quantity > 45) rejected from lineitem group by 1, 2, 3",
    "file_len": "select l_suppkey % 7 `group`, l_suppkey file_id, count(*) n_samples from lineitem group by 1, 2",
    "edit_log": "select user_id unit_id, event_id seq, case event_type when 'click' then 'edit' when 'view' then 'edit' when 'error' then 'undo' when 'purchase' then 'redo' else 'flag' end event_type, value from events",
}
SQL = {
    "spikes_ev": f"select 'P' || cast(user_id % 3 as varchar) as port, user_id as unit_id, cast((epoch_us(ts) - {EPOCH}) // 1000000 as bigint) as sample_idx, max(value) as height from events group by 1, 2, 3",
    "spikes_rec": f"select 'R' || cast(event_id % 2 as varchar) as recording_id, 'P' || cast(user_id % 3 as varchar) as port, user_id as unit_id, cast((epoch_us(ts) - {EPOCH}) // 1000000 as bigint) as sample_idx, max(value) as height from events group by 1, 2, 3, 4",
    "samples_emb": "select cast(u.i - 1 as int) as channel, vec_id as sample_idx, cast(embedding[u.i] as double) as x from embeddings, unnest(range(1, 65)) as u(i)",
    "spikes_lab": "select cast(label as bigint) as unit_id, vec_id as sample_idx from embeddings",
    "force_hr": f"select 0 as channel, cast((epoch_us(ts) - {EPOCH}) // 3600000000 as bigint) as sample_idx, sum(value) as x from events group by 1, 2",
    "masks": "select l_suppkey as file_id, l_linenumber % 2 as port, l_partkey % 64 as channel, bool_or(l_returnflag = 'R' and l_quantity > 45) as rejected from lineitem group by 1, 2, 3",
    "edit_log": "select user_id as unit_id, event_id as seq, case event_type when 'click' then 'edit' when 'view' then 'edit' when 'error' then 'undo' when 'purchase' then 'redo' else 'flag' end as event_type from events",
    "file_len": "select l_suppkey % 7 as grp, l_suppkey as file_id, count(*) as n_samples from lineitem group by 1, 2",
}
_BASE = {"spikes_ev": "events", "spikes_rec": "events", "samples_emb": "embeddings", "spikes_lab": "embeddings", "force_hr": "events", "masks": "lineitem", "file_len": "lineitem", "edit_log": "events"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_SPARK[name].replace(f"from {_BASE[name]}", "from {base}", 1), base=spark.read.parquet(f"{sf_dir}/{_BASE[name]}.parquet"))


def ctes(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names)
