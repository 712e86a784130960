"""The university pack on small raw text tables, with results worked out by hand."""

import uuid

import pytest

from tests.conftest import rows
from tierworks.plans.campus import Campus, serving_views
from tierworks.sources import read_layer


def table(spark, columns, *data):
    names = columns.split()
    return spark.createDataFrame([tuple(d) for d in data], ", ".join(f"{c} string" for c in names))


@pytest.fixture(scope="module")
def bronze(spark):
    return {
        "raw_prodi": table(
            spark, "prodi_id nama_prodi jenjang fakultas_id jurusan_id nama_fakultas tahun_berdiri status",
            ("IF", "Informatika", "S1", "FTI", "FTI", "Fakultas Teknologi Industri", "2014", "Aktif"),
            ("SD", "Sains Data", "S1", None, "FS", None, "2018", "Aktif"),
            ("MFI", "Magister Fisika", "S2", "FS", "FS", "Fakultas Sains", "2020", "Aktif"),
        ),
        "raw_mahasiswa": table(
            spark, "mahasiswa_id nama prodi_id fakultas_id jurusan_id angkatan jalur_masuk jenis_kelamin asal_provinsi status_aktif sks_luar_kampus",
            ("m1", "A", "IF", None, "FTI", "2021", "x", "L", "p", "Aktif", "20"),
            ("m2", "B", "IF", "FTI", "FTI", "2021", "x", "P", "p", "Aktif", "19"),
            ("m3", "C", "SD", None, "FS", "2021", "x", "P", "p", None, ""),
            ("m4", "D", "SD", None, "FS", "2021", "x", "P", "p", "Cuti", "24"),
            ("m5", "E", "XX", None, "JTK", "bad", "x", "P", "p", "Aktif", "30"),
            ("m1", "A", "IF", None, "FTI", "2021", "x", "L", "p", "Aktif", "20"),
        ),
        "raw_prestasi_mahasiswa": table(
            spark, "prestasi_id mahasiswa_id tingkat", ("a", "m2", "Nasional"), ("b", "m2", "Internasional"), ("c", "m3", "Regional"),
        ),
        "raw_lulusan": table(
            spark, "lulusan_id mahasiswa_id prodi_id tanggal_lulus status_pasca_lulus nama_perusahaan",
            ("l1", "a", "IF", "2024-05-01", "Bekerja", "X"), ("l2", "b", "IF", "2024-06-01", "Studi Lanjut", "Y"),
            ("l3", "c", "IF", "2024-07-01", "Belum", "Z"), ("l4", "d", "IF", "2019-07-01", "Wirausaha", "Q"),
            ("l5", "e", "IF", "not a date", "Bekerja", "X"),
        ),
        "raw_dosen": table(
            spark, "dosen_id nama prodi_id fakultas_id jurusan_id pendidikan_terakhir jabatan_fungsional status_asn sertifikat_dosen berasal_praktisi ingested_at",
            ("d1", "A", "IF", "FTI", "FTI", "S3", "Lektor", "PNS", "True", "True", "t"),
            ("d2", "B", "IF", "FTI", "FTI", "S2", "Lektor", "PNS", "False", "False", "t"),
            ("d3", "C", "SD", "FS", "FS", "S3", "Lektor", "PNS", "False", "False", "t"),
        ),
        "raw_kegiatan_dosen": table(
            spark, "kegiatan_id dosen_id jenis_kegiatan tahun",
            ("k1", "d1", "QS100", "2024"), ("k2", "d1", "Pembina_Prestasi", "2024"), ("k3", "d2", "Lainnya", "2024"), ("k4", "zz", "QS100", "2024"),
        ),
        "raw_penelitian": table(
            spark, "penelitian_id judul dosen_id jurusan_id tahun dana ingested_at rekognisi_internasional diterapkan_masyarakat",
            ("p1", "j", "d1", "FTI", "2024", "10", "t", "True", "True"), ("p2", "j", "d3", None, "2024", "10", "t", "True", "False"),
        ),
        "raw_pengabdian": table(
            spark, "pkm_id judul dosen_id jurusan_id tahun dana ingested_at rekognisi_internasional diterapkan_masyarakat",
            ("q1", "j", "d2", "FTI", "2024", "10", "t", "False", "True"),
        ),
        "raw_kerjasama": table(
            spark, "kerjasama_id prodi_id status lingkup", ("s1", "IF", "Aktif", "MBKM"), ("s2", "", "Aktif", "Riset"), ("s3", "SD", "Selesai", "Semua"),
        ),
        "raw_akreditasi": table(
            spark, "akreditasi_id prodi_id lembaga tanggal_sk tanggal_berakhir",
            ("a1", "IF", "BAN-PT", "2020-01-01", "2025-01-01"), ("a2", "IF", "Internasional", "2023-01-01", "2024-07-01"),
            ("a3", "SD", "Internasional", "2023-01-01", "2024-06-30"),
        ),
        "raw_keuangan": table(
            spark, "anggaran_id tahun pagu realisasi", ("1", "2024", "1000", "900"), ("2", "2024", "1000", "805"), ("3", "2019", "10", "x"),
        ),
    }


@pytest.fixture(scope="module")
def campus(spark, bronze):
    return Campus(spark, bronze, "2024-07-01")


def test_silver(campus):
    students = {r["mahasiswa_id"]: r for r in campus.students().collect()}
    assert len(students) == 5
    assert (students["m1"]["fakultas_id"], students["m1"]["nama_prodi"], students["m1"]["is_mbkm"]) == ("FTI", "Informatika", True)
    assert (students["m3"]["fakultas_id"], students["m3"]["nama_jurusan"], students["m3"]["is_mbkm"]) == ("FS", "Fakultas Sains", None)
    assert (students["m5"]["fakultas_id"], students["m5"]["nama_jurusan"]) == (None, None)
    active = {r["dosen_id"]: r["is_aktif_tridarma"] for r in campus.lecturers().collect()}
    assert active == {"d1": True, "d2": True, "d3": False}
    assert campus.research().count() == 3
    assert rows(campus.partnerships().select("kerjasama_id", "is_mbkm")) == [("s1", True), ("s2", False)]
    assert rows(campus.accreditations().select("akreditasi_id", "is_internasional")) == [("a2", True)]


def test_facts(campus):
    facts = campus.facts()
    grad = {r["waktu_id"]: r for r in facts["fact_iku1_lulusan"].collect()}
    assert (grad[202412]["total_lulusan"], grad[202412]["lulusan_belum"], grad[202412]["persen_terserap"], grad[202412]["capaian_iku"]) == (3, 1, 66.67, 85.47)
    assert grad[201912]["target_iku"] is None and len(grad) == 2
    act = {r["prodi_id"]: r for r in facts["fact_iku2_mbkm"].collect()}
    assert (act["IF"]["total_mahasiswa_aktif"], act["IF"]["mahasiswa_memenuhi_iku2"], act["IF"]["persen_iku2"], act["IF"]["capaian_iku"]) == (2, 2, 100.0, 500.0)
    assert (act["SD"]["total_mahasiswa_aktif"], act["SD"]["persen_iku2"], act["XX"]["waktu_id"]) == (1, 0.0, None)
    three = facts["fact_iku3_dosen_tridarma"].first()
    assert (three["total_dosen_tetap"], three["dosen_qs100"], three["dosen_memenuhi_iku3"], three["persen_iku3"]) == (2, 1, 1, 50.0)
    four = {r["prodi_id"]: r for r in facts["fact_iku4_kualifikasi_dosen"].collect()}
    assert (four["IF"]["dosen_memenuhi_iku4"], four["IF"]["persen_iku4"], four["IF"]["capaian_iku"], four["IF"]["waktu_id"]) == (3, 150.0, 300.0, 202412)
    five = {r["jurusan_id"]: r for r in facts["fact_iku5_penelitian_pkm"].collect()}
    assert (five["FTI"]["total_output_eligible"], five["FTI"]["total_dosen"], five["FTI"]["rasio_per_dosen"], five["FTI"]["capaian_iku"]) == (3, 2, 1.5, 600.0)
    assert five["FS"]["rasio_per_dosen"] == 1.0
    six = {r["waktu_id"]: r for r in facts["fact_iku6_kerjasama_prodi"].collect()}
    assert len(six) == 5 and (six[202412]["total_prodi_s1"], six[202412]["persen_iku6"], six[202412]["capaian_iku"]) == (2, 50.0, 83.33)
    eight = {r["waktu_id"]: r for r in facts["fact_iku8_akreditasi_internasional"].collect()}
    assert eight[202112]["capaian_iku"] == 2000.0
    money = {r["waktu_id"]: r for r in facts["fact_tata_kelola"].collect()}
    assert (money[202412]["persen_realisasi"], money[202412]["nilai_sakip"], money[202412]["predikat_sakip"]) == (85.25, 81.0, "BB")
    assert money[201912]["persen_realisasi"] is None and money[201912]["target_kinerja_anggaran"] is None


def test_recap_and_teaching(spark, bronze, campus):
    got = {(r["iku_kode"], r["waktu_id"]): r for r in campus.recap().collect()}
    assert len(got) == 40
    # No course table: the default line of the KPI.
    assert got["IKU-7", 202112]["nilai_capaian"] == 21.25 and got["IKU-7", 202512]["nilai_capaian"] == 43.65
    assert got["IKU-1", 202412]["nilai_capaian"] == 66.67 and got["IKU-1", 202412]["status_capaian"] == "On Track"
    assert got["IKU-5", 202412]["satuan"] == "Rasio"
    courses = table(spark, "prodi_id tahun is_case_method is_team_based", ("IF", "2024", "true", "true"), ("IF", "2024", "true", "false"), ("IF", "2024", "false", "false"))
    taught = Campus(spark, bronze, "2024-07-01", courses=courses).facts()["fact_iku7_metode_pembelajaran"].first()
    assert (taught["total_mk"], taught["mk_memenuhi"], taught["persen_iku7"], taught["capaian_iku"]) == (3, 3, 100.0, 250.0)


def test_unknown_target_as_before(spark, bronze):
    old = Campus(spark, bronze, "2024-07-01", unknown_target="floor").graduate_outcome().filter("waktu_id = 201912").first()
    assert (old["target_iku"], old["capaian_iku"]) == (None, 10000.0)


def test_dimensions_and_views(campus):
    dims, facts = campus.dimensions(), campus.facts()
    assert dims["dim_waktu"].count() == 72 and dims["dim_topik_penelitian"].count() == 4
    org = {r["prodi_id"]: r for r in dims["dim_prodi"].collect()}
    assert (org["SD"]["fakultas_id"], org["SD"]["nama_fakultas"], org["SD"]["nama_jurusan"]) == ("FS", "Fakultas Sains", "Fakultas Sains")
    assert dims["dim_mahasiswa"].count() == 5 and "pendidikan" in dims["dim_dosen"].columns
    views = serving_views(dims, facts, campus.recap())
    assert views["v_rekap_iku_tahun"].count() == 40
    assert rows(views["v_roll_up_fakultas"].select("fakultas_id", "avg_iku4")) == [("FS", 100.0), ("FTI", 150.0)]
    # One row per faculty and year, though a faculty has several programmes.
    assert views["v_iku5_fakultas"].count() == 2
    assert views["v_iku1_prodi"].count() == 1 and views["v_iku1_prodi"].first()["lulusan_terserap"] == 2
    assert rows(views["v_prodi_vs_institusi"].select("avg_persen_iku4", "avg_all")) == [(100.0, 125.0), (150.0, 125.0)]


def test_build_writes_layers(spark, campus):
    prefix = f"c{uuid.uuid4().hex[:8]}_"
    got = campus.build(prefix=prefix)
    state = {r["table_name"]: r["written"] for r in got.collect()}
    assert len(state) == 6 + 5 + 8 + 1 and all(state.values())
    assert read_layer(spark, f"{prefix}gold", "fact_rekap_iku_institusi").count() == 40


def test_rejected_source_is_not_written(spark, bronze):
    poor = dict(bronze, raw_kerjasama=table(spark, "kerjasama_id prodi_id status lingkup", ("s1", None, "Aktif", None), (None, None, "", " ")))
    prefix = f"r{uuid.uuid4().hex[:8]}_"
    got = {r["table_name"]: r for r in Campus(spark, poor, "2024-07-01").build(prefix=prefix).collect()}
    assert got["silver_kerjasama_aktif"]["error"].startswith("REJECT")
    # The fact that needs it fails, the others and the recap are built.
    failed = {name for name, r in got.items() if not r["written"]}
    assert failed == {"silver_kerjasama_aktif", "fact_iku6_kerjasama_prodi"}
    assert "build layer" in got["fact_iku6_kerjasama_prodi"]["error"]
    recap = read_layer(spark, f"{prefix}gold", "fact_rekap_iku_institusi")
    assert recap.filter("iku_kode = 'IKU-6' AND waktu_id = 202112").first()["nilai_capaian"] == 29.75
