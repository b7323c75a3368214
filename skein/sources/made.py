"""A made project: source files written from the driver's tables, so that what an index must find in them is known.

Every part is a component, every supplier a store, every nation a card, a mixin and a module of functions, every region a
router and a main-process file; one preload script bridges all nations.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.fs as pafs
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.config import Config, Relationship
from skein.sources.tables import read

ROOT = "/app/src"

PART = """<template>
  <div>
    <Card$n$ />
    <part-$q$ size="1" />
    <router-view />
  </div>
</template>
<script>
import { useShop$s$Store } from '../store/shop$s$'
import Nation$n$ from '@/mixins/Nation$n$'
/**
 * @owner team$t$
 * @since 1.$t$
 */
export default {
  name: 'Part$p$',
  mixins: [Nation$n$],
  methods: {
    load$p$() {
      const shop = useShop$s$Store()
      shop.add$s$(2)
      return this.step$p$(shop.stock$s$)
    },
    step$p$(x) {
      window.api.get$n$(x)
      return fetch$n$(x)
    },
  },
}
</script>
"""

STORE = """import { defineStore } from 'pinia'
import { fetch$n$ } from '../api/fetch$n$'

export const useShop$s$Store = defineStore('shop$s$', {
  state: { stock$s$: 0, total: 1 },
  getters: { sum$s$: (x) => x },
  actions: {
    add$s$() {
      return fetch$n$(1)
    },
  },
})
"""

API = """const cache = new Cache$n$(1)
export function fetch$n$(x) {
  return cache.read(x)
}
"""

MIXIN = """export default {
  data() {
    return {}
  },
}
"""

CARD = """<template>
  <b>card</b>
</template>
<script setup lang="ts">
import { ref } from 'vue'
const props = defineProps(['size'])
const open = ref($n$)
</script>
"""


ROUTE = """  { path: '/n$n$/', name: 'n$n$', component: () => import('../components/Card$n$.vue'), children: [
    { path: 'list', name: 'list$n$' },
    { path: '/abs$n$', name: 'abs$n$' },
  ] },
"""


def fill(template: str, **values: Column | str) -> Column:
    """``template`` with ``$x$`` replaced by the value of that name."""
    parts = re.split(r"\$(\w+)\$", template)
    return F.concat(*[(F.col(values[x]) if isinstance(values[x], str) else values[x]).cast("string") if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, rel_path, content, length) as of files that were read."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    part = part.select("p", (F.col("p") % 10).alias("s"), (F.col("p") % 25).alias("n"), (F.col("p") - F.col("p") % 2).alias("q"), (F.col("p") % 7).alias("t"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))

    def lines(template: str) -> Column:
        """A text of each nation of a group, in order; a handful a region, a table of nations in all."""
        return F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: fill(template, n=n)), "")

    router = F.concat(F.lit("export default [\n"), lines(ROUTE), F.lit("]\n"))
    main = F.concat(F.lit("import { ipcMain } from 'electron'\n"), lines("ipcMain.handle('get-$n$', () => 1)\n"))
    preload = F.concat(F.lit("contextBridge.exposeInMainWorld('api', {\n"), lines("  get$n$: (x) => x,\n"), F.lit("})\n"))
    made = [
        part.select(fill("components/Part$p$.vue", p="p").alias("rel_path"), fill(PART, p="p", q="q", s="s", n="n", t="t").alias("content")),
        supplier.select(fill("store/shop$s$.js", s="s").alias("rel_path"), fill(STORE, s="s", n="n").alias("content")),
        *[nation.select(fill(path, n="n").alias("rel_path"), fill(text, n="n").alias("content")) for path, text in (("api/fetch$n$.js", API), ("mixins/Nation$n$.js", MIXIN), ("components/Card$n$.vue", CARD))],
        nation.groupBy("r").agg(router.alias("content")).select(fill("router/region$r$.js", r="r").alias("rel_path"), "content"),
        nation.groupBy("r").agg(main.alias("content")).select(fill("main/region$r$.ts", r="r").alias("rel_path"), "content"),
        nation.agg(preload.alias("content")).select(F.lit("preload/index.ts").alias("rel_path"), "content"),
    ]
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    every = every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # small tables come in few partitions, files don't
    return every.select(F.concat(F.lit(f"{ROOT}/"), "rel_path").alias("path"), "rel_path", "content", F.length("content").cast("long").alias("length"))


def write(files: DataFrame, place: str) -> None:
    """Write the files below ``place``, the address of a folder that all executors share, with what else a project has."""
    folder = f"{place}/src"

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        there = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (above := f"{base}/{path}".rpartition("/")[0]) not in there:
                    fs.create_dir(above, recursive=True)
                    there.add(above)
                with fs.open_output_stream(f"{base}/{path}") as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    files.select("rel_path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()
    own, (fs, base) = config(), pafs.FileSystem.from_uri(place)
    relations = {name: {"from": r.source, "to": r.target, "detect_by": [{"type": kind, "pattern": pattern} for kind, pattern in r.detect_by]} for name, r in own.relationships.items()}
    about = {
        "project": {"name": own.name, "source_root": "src"},
        "entities": {name: {"patterns": patterns} for name, patterns in own.entities.items()},
        "framework_apis": [{"name": name, "api_list": names} for name, names in own.apis.items()],
        "relationships": relations,
    }
    package = {"name": "made", "version": "1.0.0", "dependencies": {"vue": "3", "pinia": "2"}}
    tsconfig = {"compilerOptions": {"baseUrl": ".", "paths": {"#mixins/*": ["src/mixins/*"]}}}
    for name, text in (("skein.yaml", yaml.safe_dump(about)), ("package.json", json.dumps(package)), ("tsconfig.json", json.dumps(tsconfig))):
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(text.encode())


def config() -> Config:
    """The project's own part of the configuration; the built-in plugin adds the rest."""
    relations = {
        "shows": Relationship("route", "component", [("import_expression", "Card")]),
        "asks": Relationship("store", "api", [("call_expression", "fetch*")]),
    }
    return Config("made", ROOT, {"api": ["api/**/*.js"]}, {"shop": ["fetch1"]}, relations)
