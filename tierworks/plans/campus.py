"""The university star schema: raw text tables to silver, dimensions, KPI facts, recap and serving views.

All raw columns are text and are typed here, with NULL for what cannot be read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierworks.functions import as_bool, year_of
from tierworks.operators import gold, kpi, olap, quality, silver
from tierworks.operators.joins import lookup, one_per_level
from tierworks.operators.profile import union_all
from tierworks.operators.shape import ensure_column, first_of_duplicate_columns
from tierworks.plans.run import new_run_id, run_layer, Spec
from tierworks.sources import layer_name, literal_table, read_layer

# KPI targets per year.
TARGETS: dict[str, dict[int, float]] = {
    "IKU-1": {2021: 75, 2022: 76, 2023: 77, 2024: 78, 2025: 80},
    "IKU-2": {2021: 20, 2022: 25, 2023: 30, 2024: 35, 2025: 40},
    "IKU-3": {2021: 15, 2022: 17, 2023: 20, 2024: 25, 2025: 30},
    "IKU-4": {2021: 30, 2022: 32, 2023: 40, 2024: 50, 2025: 55},
    "IKU-5": {2021: 0.10, 2022: 0.15, 2023: 0.20, 2024: 0.25, 2025: 0.30},
    "IKU-6": {2021: 35, 2022: 40, 2023: 50, 2024: 60, 2025: 65},
    "IKU-7": {2021: 25, 2022: 30, 2023: 35, 2024: 40, 2025: 45},
    "IKU-8": {2021: 2.5, 2022: 2.5, 2023: 2.5, 2024: 3.0, 2025: 5.0},
}
# Governance grades and budget targets per year.
GRADES = {2021: "BB", 2022: "BB", 2023: "BB", 2024: "BB", 2025: "A"}
BUDGET_GOALS = {2021: 80, 2022: 85, 2023: 85, 2024: 85, 2025: 87}
FALLBACK_YEAR = 2024
YEARS = tuple(range(2021, 2026))
CALENDAR_YEARS = (2020, 2025)
# Faculty names.
FACULTIES = {
    "FS": "Fakultas Sains",
    "FTI": "Fakultas Teknologi Industri",
    "FTIK": "Fakultas Teknologi Infrastruktur dan Kewilayahan",
}
# Research topics.
TOPICS = [
    (1, "Sustainable Energy", "Energi terbarukan dan berkelanjutan"),
    (2, "Innovative Industry", "Industri inovatif dan teknologi terapan"),
    (3, "Green Infrastructure", "Infrastruktur hijau dan ramah lingkungan"),
    (4, "Community Development", "Pengembangan masyarakat dan wilayah"),
]
# Recap lines as (code, name, fact, value column).
RECAP_LINES = [
    ("IKU-1", "Lulusan bekerja/studi lanjut/wirausaha", "fact_iku1_lulusan", "persen_terserap"),
    ("IKU-2", "Mahasiswa MBKM ≥20 SKS / prestasi nasional", "fact_iku2_mbkm", "persen_iku2"),
    ("IKU-3", "Dosen tridarma luar/praktisi/bina prestasi", "fact_iku3_dosen_tridarma", "persen_iku3"),
    ("IKU-4", "Dosen S3/sertifikat kompetensi/praktisi", "fact_iku4_kualifikasi_dosen", "persen_iku4"),
    ("IKU-5", "Rasio output penelitian rekognisi intl per dosen", "fact_iku5_penelitian_pkm", "rasio_per_dosen"),
    ("IKU-6", "Prodi bekerjasama dengan mitra", "fact_iku6_kerjasama_prodi", "persen_iku6"),
    ("IKU-7", "MK case method / team-based project", "fact_iku7_metode_pembelajaran", "persen_iku7"),
    ("IKU-8", "Prodi akreditasi/sertifikat internasional", "fact_iku8_akreditasi_internasional", "persen_iku8"),
]
# Columns with personal data.
PII_COLUMNS = {
    "raw_mahasiswa": ["nama", "mahasiswa_id", "asal_provinsi"],
    "raw_lulusan": ["mahasiswa_id", "nama_perusahaan"],
    "raw_dosen": ["nama", "dosen_id"],
    "raw_tendik": ["nama", "tendik_id"],
    "raw_kegiatan_dosen": ["dosen_id"],
    "raw_penelitian": ["dosen_id"],
    "raw_pengabdian": ["dosen_id"],
    "raw_mbkm": ["mahasiswa_id"],
    "raw_prestasi_mahasiswa": ["mahasiswa_id"],
}
# Columns of the cleaned lecturer table.
LECTURER_COLUMNS = [
    "dosen_id", "nama", "prodi_id", "jurusan_id", "jenis_kelamin", "status_asn", "pendidikan_terakhir",
    "jabatan_fungsional", "sedang_tugas_belajar", "sertifikat_dosen", "berasal_praktisi", "tahun_bergabung",
    "ingested_at", "is_s3", "is_praktisi", "is_serdos", "is_aktif_tridarma",
]


def _int(column: str) -> Column:
    return F.col(column).try_cast("int")


SILVER_SOURCES = {
    "silver_mahasiswa": ["raw_mahasiswa"],
    "silver_lulusan": ["raw_lulusan"],
    "silver_dosen": ["raw_dosen"],
    "silver_penelitian_pkm": ["raw_penelitian", "raw_pengabdian"],
    "silver_kerjasama_aktif": ["raw_kerjasama"],
    "silver_akreditasi_aktif": ["raw_akreditasi"],
}


class Campus:
    """Layers over the raw tables (name -> all-text DataFrame).

    ``as_of`` is the ISO date accreditations must still be valid on. ``unknown_target``
    chooses what the achievement is in a year without a target (see
    ``functions.achievement``). ``courses`` (prodi_id, tahun, is_case_method,
    is_team_based; one row per course) feeds the KPI on teaching methods; without it
    the recap falls back to its default line. ``stored`` holds cleaned tables that are
    already written; those are read in place of being built again.
    """

    def __init__(
        self,
        spark: SparkSession,
        bronze: Mapping[str, DataFrame],
        as_of: str,
        unknown_target: str = "null",
        courses: DataFrame | None = None,
        stored: Callable[[str], DataFrame] | None = None,
    ):
        self.spark, self.bronze, self.as_of = spark, bronze, as_of
        self.unknown_target, self.courses, self.stored = unknown_target, courses, stored

    def _target(self, year: str, code: str) -> Column:
        return kpi.target_for(year, TARGETS[code])

    def _scored(self, df: DataFrame, value: str, target: Column, floor: float = 1.0) -> DataFrame:
        return kpi.scored(df, value, target, floor, self.unknown_target)

    # ---- silver ----

    def cleaned(self, name: str) -> DataFrame:
        """A silver table: the written one where there is one, else built from the raw tables."""
        if self.stored is not None:
            return self.stored(name)
        build = {
            "silver_mahasiswa": self.students,
            "silver_lulusan": self.graduates,
            "silver_dosen": self.lecturers,
            "silver_penelitian_pkm": self.research,
            "silver_kerjasama_aktif": self.partnerships,
            "silver_akreditasi_aktif": self.accreditations,
        }
        return build[name]()

    def source_score(self, name: str) -> DataFrame:
        """One-row quality score of the raw tables behind a silver table."""
        parts = [quality.score(self.bronze[t], t) for t in SILVER_SOURCES[name]]
        if len(parts) == 1:
            return parts[0]
        return quality.combine(union_all(parts), " + ".join(SILVER_SOURCES[name]))

    def _programmes(self) -> DataFrame:
        """Older programme files lack the faculty columns."""
        programmes = self.bronze["raw_prodi"]
        for c in ("fakultas_id", "nama_fakultas", "jurusan_id"):
            if c not in programmes.columns:
                programmes = programmes.withColumn(c, F.lit(None).cast("string"))
        return programmes.withColumn("fakultas_id", F.coalesce("fakultas_id", "jurusan_id"))

    def students(self) -> DataFrame:
        out = silver.enrich_lookup(
            self.bronze["raw_mahasiswa"], self._programmes(), "prodi_id", ["mahasiswa_id"],
            filled=[
                silver.Filled("fakultas_id", own="fakultas_id", ref="fakultas_id"),
                silver.Filled("nama_jurusan", ref="nama_fakultas", code="jurusan_id", names=FACULTIES),
            ],
            carry=["nama_prodi", "jenjang", "nama_fakultas"],
            flags={"is_mbkm": _int("sks_luar_kampus") >= 20},
        )
        return ensure_column(out, "status_aktif", "Aktif")

    def graduates(self) -> DataFrame:
        return silver.status_flags(
            self.bronze["raw_lulusan"], "status_pasca_lulus",
            {"is_employed": "Bekerja", "is_lanjut_studi": "Studi Lanjut", "is_wirausaha": "Wirausaha"},
            "is_terserap", ["lulusan_id"],
        )

    def lecturers(self) -> DataFrame:
        flagged = self.bronze["raw_dosen"].withColumns(
            {
                "is_s3": F.col("pendidikan_terakhir") == "S3",
                "is_praktisi": as_bool("berasal_praktisi"),
                "is_serdos": as_bool("sertifikat_dosen"),
            }
        )
        out = silver.activity_flag(
            flagged, self.bronze["raw_kegiatan_dosen"], "dosen_id", "jenis_kegiatan", "is_aktif_tridarma", ["dosen_id"]
        )
        return first_of_duplicate_columns(out, LECTURER_COLUMNS)

    def research(self) -> DataFrame:
        def part(table: str, key: str, tag: str) -> silver.Part:
            kept = ("judul", "dosen_id", "jurusan_id", "tahun", "dana", "ingested_at")
            return silver.Part(
                self.bronze[table], tag,
                {
                    "id": F.col(key),
                    **{c: F.col(c) for c in kept},
                    "is_rekognisi": as_bool("rekognisi_internasional"),
                    "is_diterapkan": as_bool("diterapkan_masyarakat"),
                },
            )

        return silver.union_tagged(
            [part("raw_penelitian", "penelitian_id", "Penelitian"), part("raw_pengabdian", "pkm_id", "Pengabdian")],
            "jenis", ["id"],
        )

    def partnerships(self) -> DataFrame:
        return silver.filter_active(
            self.bronze["raw_kerjasama"], "status", "Aktif", ["kerjasama_id"],
            {"is_mbkm": F.col("lingkup").isin("MBKM", "Semua")},
        )

    def accreditations(self) -> DataFrame:
        return silver.latest_valid(
            self.bronze["raw_akreditasi"], ["prodi_id"], "tanggal_sk", "tanggal_berakhir", self.as_of,
            {"is_internasional": F.col("lembaga") == "Internasional"},
        )

    # ---- dimensions ----

    def dimension_builders(self) -> dict[str, Callable[[], DataFrame]]:
        lecturer = [
            "dosen_id", "nama", "prodi_id", "status_asn", "pendidikan_terakhir", "jabatan_fungsional",
            "is_s3", "is_serdos", "is_praktisi",
        ]
        student = ["mahasiswa_id", "prodi_id", "angkatan", "jalur_masuk", "asal_provinsi", "jenis_kelamin"]
        topics = "topik_id bigint, nama_topik string, deskripsi string"
        return {
            "dim_waktu": lambda: gold.dim_calendar(self.spark, *CALENDAR_YEARS),
            "dim_prodi": self.dim_programme,
            "dim_dosen": lambda: gold.dim_project(
                self.cleaned("silver_dosen"), "dosen_id", lecturer, {"pendidikan_terakhir": "pendidikan"}
            ),
            "dim_mahasiswa": lambda: gold.dim_project(self.cleaned("silver_mahasiswa"), "mahasiswa_id", student),
            "dim_topik_penelitian": lambda: literal_table(self.spark, TOPICS, topics),
        }

    def dimensions(self) -> dict[str, DataFrame]:
        return {name: build() for name, build in self.dimension_builders().items()}

    def dim_programme(self) -> DataFrame:
        same = ("prodi_id", "nama_prodi", "jenjang", "fakultas_id", "nama_fakultas", "tahun_berdiri", "status")
        return gold.dim_from(
            self._programmes(), "prodi_id", {**{c: c for c in same}, "nama_jurusan": "nama_fakultas"},
            code="fakultas_id", names=FACULTIES, name_column="nama_fakultas",
        )

    # ---- facts ----

    def fact_builders(self) -> dict[str, Callable[[], DataFrame]]:
        builders = {
            "fact_iku1_lulusan": self.graduate_outcome,
            "fact_iku2_mbkm": self.student_activity,
            "fact_iku3_dosen_tridarma": self.lecturer_activity,
            "fact_iku4_kualifikasi_dosen": self.lecturer_standing,
            "fact_iku5_penelitian_pkm": self.research_ratio,
            "fact_iku6_kerjasama_prodi": self.partner_share,
            "fact_iku8_akreditasi_internasional": self.accredited_share,
            "fact_tata_kelola": self.budget,
        }
        if self.courses is not None:
            builders["fact_iku7_metode_pembelajaran"] = self.teaching_methods
        return builders

    def facts(self) -> dict[str, DataFrame]:
        return {name: build() for name, build in self.fact_builders().items()}

    def graduate_outcome(self) -> DataFrame:
        rows = self.cleaned("silver_lulusan").withColumn("tahun", year_of("tanggal_lulus"))
        rows = rows.filter(F.col("tahun").isNotNull() & F.col("prodi_id").isNotNull())
        outcomes = ["lulusan_bekerja", "lulusan_lanjut_studi", "lulusan_wirausaha"]
        fact = kpi.share_fact(
            rows, ["tahun", "prodi_id"], "total_lulusan",
            {
                **dict(zip(outcomes, map(F.col, ("is_employed", "is_lanjut_studi", "is_wirausaha")))),
                "lulusan_belum": ~F.col("is_terserap"),
            },
            outcomes, "persen_terserap",
        )
        fact = self._scored(fact, "persen_terserap", self._target("tahun", "IKU-1"))
        return gold.with_keys(fact, ["tahun", "prodi_id"], "tahun").drop("tahun")

    def student_activity(self) -> DataFrame:
        active = self.cleaned("silver_mahasiswa").filter(F.coalesce("status_aktif", F.lit("Aktif")) == "Aktif")
        winners = (
            self.bronze["raw_prestasi_mahasiswa"].filter(F.col("tingkat").isin("Nasional", "Internasional"))
            .select("mahasiswa_id").distinct().withColumn("won", F.lit(True))
        )
        rows = lookup(active, winners, "mahasiswa_id").withColumn("tahun", _int("angkatan"))
        won = F.coalesce("won", F.lit(False))
        fact = kpi.share_fact(
            rows, ["tahun", "prodi_id"], "total_mahasiswa_aktif",
            {
                "mahasiswa_sks_luar_20": F.col("is_mbkm"),
                "mahasiswa_prestasi_nasional": won,
                "mahasiswa_memenuhi_iku2": F.col("is_mbkm") | won,
            },
            ["mahasiswa_memenuhi_iku2"], "persen_iku2",
        )
        fact = self._scored(fact, "persen_iku2", self._target("tahun", "IKU-2"))
        return gold.with_keys(fact, ["tahun", "prodi_id"], "tahun").drop("tahun")

    def lecturer_activity(self, denominator: str = "active") -> DataFrame:
        kind = F.col("jenis_kegiatan")
        fact = kpi.any_flag_fact(
            self.bronze["raw_kegiatan_dosen"].withColumn("tahun", _int("tahun")),
            self.cleaned("silver_dosen").select("dosen_id", "prodi_id"), "dosen_id", "tahun", "prodi_id",
            {
                "dosen_tridarma_pt_lain": kind == "Tridarma_PT_Lain",
                "dosen_praktisi_industri": kind == "Praktisi_Industri",
                "dosen_bina_prestasi": kind == "Pembina_Prestasi",
                "dosen_qs100": kind == "QS100",
            },
            "total_dosen_tetap", "dosen_memenuhi_iku3", "persen_iku3", denominator,
        )
        fact = self._scored(fact, "persen_iku3", self._target("tahun", "IKU-3"))
        return gold.with_keys(fact, ["tahun", "prodi_id"], "tahun").drop("tahun")

    def lecturer_standing(self, overlap: str = "sum") -> DataFrame:
        fact = kpi.flag_sum_fact(
            self.cleaned("silver_dosen"), "prodi_id", "total_dosen_tetap",
            {
                "dosen_s3": F.col("is_s3"),
                "dosen_sertifikat_industri": F.col("is_serdos"),
                "dosen_dari_praktisi": F.col("is_praktisi"),
            },
            "dosen_memenuhi_iku4", "persen_iku4", overlap, FALLBACK_YEAR,
        )
        fact = self._scored(fact, "persen_iku4", F.lit(float(TARGETS["IKU-4"][FALLBACK_YEAR])))
        return gold.with_keys(fact, ["tahun", "prodi_id"], "tahun").drop("tahun")

    def research_ratio(self) -> DataFrame:
        heads = self.cleaned("silver_dosen").select("dosen_id", "jurusan_id")
        works = lookup(self.cleaned("silver_penelitian_pkm"), heads.withColumnRenamed("jurusan_id", "of_lecturer"), "dosen_id")
        works = works.withColumns({"tahun": _int("tahun"), "jurusan_id": F.coalesce("jurusan_id", "of_lecturer")})
        fact = kpi.ratio_fact(
            works, heads, "jurusan_id", "tahun",
            {
                "output_rekognisi_internasional": F.col("is_rekognisi"),
                "output_diterapkan_masyarakat": F.col("is_diterapkan"),
            },
            "total_dosen", "total_output_eligible", "rasio_per_dosen",
        )
        fact = self._scored(fact, "rasio_per_dosen", self._target("tahun", "IKU-5"), floor=0.01)
        return gold.with_keys(fact, ["tahun", "jurusan_id"], "tahun").drop("tahun")

    def _share(self, hits: DataFrame, met: str, value: str, code: str) -> DataFrame:
        programmes = self.bronze["raw_prodi"].filter(F.col("jenjang") == "S1").select("prodi_id")
        fact = kpi.entity_share_by_year(
            programmes, hits.select("prodi_id"), "prodi_id", "total_prodi_s1", met, value, TARGETS[code],
            fallback_year=FALLBACK_YEAR,
        )
        return gold.with_keys(fact, ["tahun"], "tahun").drop("tahun")

    def partner_share(self) -> DataFrame:
        hits = self.cleaned("silver_kerjasama_aktif").filter(F.col("prodi_id") != "")
        return self._share(hits, "prodi_berkerjasama", "persen_iku6", "IKU-6")

    def accredited_share(self) -> DataFrame:
        hits = self.cleaned("silver_akreditasi_aktif").filter("is_internasional")
        return self._share(hits, "prodi_akreditasi_internasional", "persen_iku8", "IKU-8")

    def teaching_methods(self) -> DataFrame:
        rows = self.courses.withColumn("tahun", F.col("tahun").try_cast("int"))
        fact = kpi.capped_sum_fact(
            rows, ["tahun", "prodi_id"], "total_mk",
            {"mk_case_method": as_bool("is_case_method"), "mk_team_based": as_bool("is_team_based")},
            "mk_memenuhi", "persen_iku7",
        )
        fact = self._scored(fact, "persen_iku7", self._target("tahun", "IKU-7"))
        return gold.with_keys(fact, ["tahun", "prodi_id"], "tahun").drop("tahun")

    def budget(self) -> DataFrame:
        rows = self.bronze["raw_keuangan"].withColumn("tahun", _int("tahun"))
        amount = "decimal(20,2)"
        fact = kpi.budget_fact(
            rows, "tahun", F.col("pagu").try_cast(amount), F.col("realisasi").try_cast(amount), GRADES, BUDGET_GOALS
        )
        return gold.with_keys(fact, ["tahun"], "tahun").drop("tahun")

    def recap(self, facts: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """All KPIs by year, from the facts given (say, written tables) or freshly built ones."""
        facts = self.facts() if facts is None else facts
        lines = [
            kpi.Indicator(code, name, facts.get(fact), value, "Rasio" if code == "IKU-5" else "%")
            for code, name, fact, value in RECAP_LINES
        ]
        return kpi.recap(self.spark, lines, TARGETS, YEARS, FALLBACK_YEAR)

    # ---- whole layers ----

    def silver_specs(self) -> list[Spec]:
        """Specs for a layer run; the score of a table's sources can reject it."""
        return [
            Spec(name, lambda _, name=name: self.cleaned(name), sources, score=self.source_score(name))
            for name, sources in SILVER_SOURCES.items()
        ]

    def gold_specs(self) -> list[Spec]:
        builders = {**self.dimension_builders(), **self.fact_builders()}
        return [Spec(name, lambda _, build=build: build()) for name, build in builders.items()]

    def build(self, location: str | None = None, scenario: str | None = None, prefix: str = "") -> DataFrame:
        """Write silver, gold and then the recap from the written facts; returns all ledger entries."""
        layers = f"{prefix}silver", f"{prefix}gold"
        silver_run = run_layer(self.spark, layers[0], self.silver_specs(), "bronze_to_silver", scenario, location)
        # Gold reads the cleaned tables just written; one that was rejected fails its own facts only.
        on_silver = Campus(
            self.spark, self.bronze, self.as_of, self.unknown_target, self.courses,
            stored=lambda name: read_layer(self.spark, layers[0], name, scenario),
        )
        gold_id = new_run_id()
        gold_run = run_layer(self.spark, layers[1], on_silver.gold_specs(), "silver_to_gold", scenario, location, run_id=gold_id)
        written = {
            fact: read_layer(self.spark, layers[1], fact, scenario)
            for _, _, fact, _ in RECAP_LINES
            if self.spark.catalog.tableExists(f"{layer_name(layers[1], scenario)}.{fact}")
        }
        recap = Spec("fact_rekap_iku_institusi", lambda _: self.recap(written), ["all_iku_facts"])
        recap_run = run_layer(self.spark, layers[1], [recap], "silver_to_gold", scenario, location, run_id=gold_id)
        return silver_run.unionByName(gold_run).unionByName(recap_run)


# ---- serving views ----------------------------------------------------------------


def serving_views(dims: Mapping[str, DataFrame], facts: Mapping[str, DataFrame], recap: DataFrame) -> dict[str, DataFrame]:
    """The dashboards' views over dimensions, facts and recap, by name."""
    time, org = dims["dim_waktu"], dims["dim_prodi"]
    faculty = one_per_level(org, ["fakultas_id", "nama_fakultas"]).withColumnRenamed("fakultas_id", "jurusan_id")
    by_year = olap.star(recap, {"waktu_id": time})
    standing = olap.star(facts["fact_iku4_kualifikasi_dosen"], {"prodi_id": org, "waktu_id": time})
    views = {
        "v_rekap_iku_tahun": by_year.select(
            "tahun", "iku_kode", "iku_nama", "nilai_capaian", "nilai_target", "satuan", "status_capaian"
        ).orderBy("tahun", "iku_kode"),
        "v_iku4_per_prodi": standing.select(
            "prodi_id", "nama_prodi", "fakultas_id", "nama_fakultas", "total_dosen_tetap", "dosen_s3",
            "dosen_sertifikat_industri", "persen_iku4", "target_iku", "capaian_iku",
        ).orderBy(F.desc("persen_iku4"), "prodi_id"),
        "v_tata_kelola_tahun": olap.star(facts["fact_tata_kelola"], {"waktu_id": time}).select(
            "tahun", "predikat_sakip", "nilai_sakip", "pagu_total", "realisasi_total", "persen_realisasi",
            "target_kinerja_anggaran",
        ).orderBy("tahun"),
        "v_roll_up_fakultas": olap.rollup(
            standing, ["fakultas_id", "nama_fakultas", "tahun"], {"persen_iku4": olap.SEMI_ADDITIVE}
        ).withColumnRenamed("avg_persen_iku4", "avg_iku4").orderBy("tahun", "fakultas_id"),
        "v_prodi_vs_institusi": olap.against_overall(standing, ["nama_prodi", "nama_fakultas"], "persen_iku4"),
        "v_iku5_fakultas": olap.star(
            facts["fact_iku5_penelitian_pkm"], {"jurusan_id": faculty, "waktu_id": time}
        ).select("tahun", F.col("jurusan_id").alias("fakultas_id"), "nama_fakultas", "rasio_per_dosen", "target_iku", "capaian_iku"),
    }
    per_programme = {
        "v_iku1_prodi": ("fact_iku1_lulusan", ["total_lulusan", "lulusan_terserap", "persen_terserap", "target_iku", "capaian_iku"]),
        "v_iku2_prodi": ("fact_iku2_mbkm", ["persen_iku2", "mahasiswa_memenuhi_iku2", "target_iku"]),
        "v_iku3_prodi": ("fact_iku3_dosen_tridarma", ["persen_iku3", "dosen_memenuhi_iku3", "target_iku"]),
        "v_iku7_prodi": ("fact_iku7_metode_pembelajaran", ["persen_iku7", "target_iku"]),
    }
    for name, (fact, columns) in per_programme.items():
        if fact not in facts:
            continue
        df = facts[fact]
        if fact == "fact_iku1_lulusan":
            df = df.withColumn("lulusan_terserap", F.col("total_lulusan") - F.col("lulusan_belum"))
        views[name] = olap.star(df, {"prodi_id": org, "waktu_id": time}).select("tahun", "nama_prodi", *columns)
    for name, fact, value in (
        ("v_iku6_institusi", "fact_iku6_kerjasama_prodi", "persen_iku6"),
        ("v_iku8_institusi", "fact_iku8_akreditasi_internasional", "persen_iku8"),
    ):
        views[name] = olap.star(facts[fact], {"waktu_id": time}).select("tahun", value, "target_iku")
    return views
