import json

from normspark.sources import catalogs as C
from normspark.sources import histories as H
from normspark.sources import landed as L
from normspark.sources import proceedings as P


def put(path, name, body):
    (path / name).write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return f"file://{path / name}"


def test_senate_list(spark, tmp_path):
    one = '<documento id="900104"><numero>4321</numero><norma>LEI-4321</norma><normaNome>Lei nº 4.321 de 05/06/2011</normaNome><ementa>Feiras.</ementa><dataassinatura>05/06/2011</dataassinatura><anoassinatura>2011</anoassinatura></documento>'
    bad = '<documento id="x"><normaNome></normaNome><anoassinatura>abc</anoassinatura></documento>'
    path = put(tmp_path, "list.xml", f"<Lista><documentos>{one}{one}{bad}</documentos></Lista>")
    good, rejected = sorted(C.senate(spark, path, "Lei", 2011).collect(), key=lambda r: r.reject or "")
    assert (good.remote_id, good.number, good.year, str(good.signed_at), good.reject) == ("900104", "4.321", 2011, "2011-06-05", None)
    assert rejected.reject.startswith("id,year,title")


def test_alesp_page(spark, tmp_path):
    row = {"idNorma": "55501", "tipo": "Decreto", "nuNorma": "8117", "data": "09/03/1987", "dataPublicacao": None, "nomeNorma": "Decreto nº 8.117, de 09/03/1987", "dsEmenta": "E."}
    rows = [row | {"urlIntegraListaPesquisa": "https://www.al.sp.gov.br/repositorio/legislacao/a.html"}, row | {"idNorma": "2", "urlIntegraListaPesquisa": "http://evil.example/repositorio/legislacao/a"}, row | {"idNorma": "3", "data": "?"}]
    got = {r.remote_id: r for r in C.alesp(spark, put(tmp_path, "p.json", {"number": 0, "content": rows})).collect()}
    assert got["55501"].text_url and got["2"].text_url is None and got["3"].reject == "date" and got["2"].number == "8.117" and got["2"].year == 1987


def test_sapl_and_sinj_pages(spark, tmp_path):
    types = spark.createDataFrame([("1", "Lei")], "id string, law_type string")
    rows = [{"id": 5, "tipo": 1, "numero": "10", "ano": 1999, "data": "1999-05-01", "esfera_federacao": "M", "__str__": "Lei nº 10"}, {"id": 6, "tipo": 2, "ano": "x", "esfera_federacao": "Q"}]
    got = {r.remote_id: r for r in C.sapl(spark, put(tmp_path, "s.json", {"pagination": {"page": 1}, "results": rows}), types, "M").collect()}
    assert got["5"].law_type == "Lei" and got["5"].reject is None and got["6"].reject == "type,year,scope" and got["6"].number == "s/n"
    src = {"ch_norma": "A" * 32, "nm_tipo_norma": "Portaria", "nr_norma": "0", "dt_assinatura": "01/02/2015", "fontes": [{"dt_publicacao": "?"}, {"dt_publicacao": "03/02/2015", "ar_fonte": {"mimetype": "Text/HTML"}}], "ar_atualizado": {"mimetype": "application/pdf"}}
    (r,) = C.sinj(spark, put(tmp_path, "j.json", {"aaData": [{"_id": "9", "_source": src}]})).collect()
    assert (r.number, str(r.published_at), r.attachments, r.title, r.status, r.reject) == ("s/n", "2015-02-03", ["application/pdf", "text/html"], "Portaria s/n de 01/02/2015", "Não verificado", None)


def test_jurisdictions(spark, tmp_path):
    states = put(tmp_path, "st.json", [{"id": 35, "sigla": "SP", "nome": "São Paulo"}])
    towns = put(tmp_path, "to.json", [{"id": 1, "nome": "A", "microrregiao": {"mesorregiao": {"UF": {"sigla": "SP"}}}}, {"id": 2, "nome": "B", "regiao-imediata": {"regiao-intermediaria": {"UF": {"sigla": "SP"}}}}, {"id": 2605459, "nome": "N", "microrregiao": {"mesorregiao": {"UF": {"sigla": "PE"}}}}])
    got = {r.id: r for r in C.jurisdictions(spark, states, towns).collect()}
    assert got["br-sp-2"].parent_id == "br-sp" == got["br-sp-1"].parent_id and got["br-sp"].parent_id == "br" and not got["br-pe-2605459"].legislature_eligible


def test_archive_is_idempotent(spark, tmp_path):
    raw = spark.createDataFrame([("a", bytearray(b"x")), ("a", bytearray(b"x")), ("b", bytearray(b"x"))], "law_slug string, raw_body binary")
    none = spark.createDataFrame([], "law_slug string, checksum string")
    first = C.archive(none, raw)
    path = f"file://{tmp_path}/arch"
    C.write_partitioned(first, path, "sha_prefix")
    assert first.count() == 2 and C.archive(spark.read.parquet(path), raw).count() == 0
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "d.html").write_bytes(b"<p>x</p>")
    assert C.raw_documents(spark, f"file://{tmp_path}/raw").first().size_bytes == 8
    assert C.seed_catalog(spark).count() == 3


def test_relations(spark, tmp_path):
    xml = """<Doc><documentos><documento><identificacao><numero>1</numero></identificacao><disps><disp><nomeDispositivo>Art. 1</nomeDispositivo><refs>
      <ref><comentario>Altera</comentario><codNormaPosterior>77</codNormaPosterior><dispositivo>Lei nº 5 de 01/02/2003</dispositivo></ref>
      <ref><comentario>Revoga</comentario><codNormaPosterior>77</codNormaPosterior><dispositivo>Lei nº 5 de 01/02/2003</dispositivo></ref>
      <ref><comentario>Cita</comentario><codNormaPosterior>78</codNormaPosterior><dispositivo>Lei 6</dispositivo></ref></refs></disp></disps></documento></documentos></Doc>"""
    (r,) = H.senate_relations(spark, put(tmp_path, "r.xml", xml)).collect()
    assert (r.source_id, r.relation, str(r.signed_at)) == ("77", "Revoga", "2003-02-01")
    note = {"tipoAnotacao": "Alterada por", "idNormaAnotadora": "12", "idAnotacao": "3", "nomeNorma": "Lei 9", "anotadoraTxNorma": "<b>Texto</b>  aqui", "anotadoraDtNorma": "01/02/2003"}
    detail = {"idNorma": "1", "anotacoesAlteracao": [note, note | {"tipoAnotacao": "Ver"}], "anotacaoOutras": [note | {"nomeNorma": "Lei 10"}, note | {"idNormaAnotadora": "x"}]}
    (r,) = H.alesp_relations(spark, put(tmp_path, "a.json", detail)).collect()
    assert (r.source_id, r.event_label, r.excerpt) == ("alesp:3", "Lei 10", "Texto aqui")
    vide = {"in_norma_afetada": True, "ds_texto_relacao": "Revogado parcialmente", "ch_vide": "5", "ch_norma_vide": "6", "nm_tipo_norma_vide": "Lei", "nr_norma_vide": "7", "artigo_norma_vide": "3", "inciso_norma_vide": " "}
    (r,) = H.sinj_relations(spark, put(tmp_path, "v.json", {"vides": [vide, vide | {"in_norma_afetada": False, "ch_vide": "9"}]})).collect()
    assert (r.device_ref, r.event_label) == ("art. 3", "Lei 7")
    types = spark.createDataFrame([("2", "revoga")], "id string, name string")
    edges = {"results": [{"id": 1, "norma_principal": 10, "norma_relacionada": 20, "tipo_vinculo": 2}]}
    got = sorted(tuple(x) for x in H.sapl_relations(spark, put(tmp_path, "e.json", edges), types).select("norm", "other", "relation").collect())
    assert got == [("10", "20", "revoga"), ("20", "10", "revoga")]


def test_votes_and_text_versions(spark):
    votes = {"VotacoesComissao": {"Votacoes": {"Votacao": [{"SiglaColegiado": "CCJ", "Votos": {"Voto": [{"NomeParlamentar": "A", "Voto": "SIM"}, {"NomeParlamentar": "B", "Voto": "NÃO"}]}}]}}}
    rows = P.committee_votes(spark.createDataFrame([("l", json.dumps(votes)), ("m", "{}")], "law string, doc string"), "law", "doc").collect()
    assert [(r.law, r.member, r.vote) for r in rows if r.member] == [("l", "A", "SIM"), ("l", "B", "NÃO")]
    ident, src = "urn:x!art7_par2", {"@id": "urn:lex:br:federal:lei:2012-07-09;15321@2012", "name": "Lei 15.321"}
    part = {"hasPart": [{"workExample": [{"legislationIdentifier": ident, "text": "um ", "legislationDate": "2000-01-01"}], "hasPart": {"workExample": {"legislationIdentifier": ident, "text": "dois", "legislationDate": "2012-07-09", "additionalType": "Text_Change", "legislationConsolidates": [src]}}}]}
    got = H.text_versions(spark.createDataFrame([("l", json.dumps(part)), ("bad", "{")], "law string, doc string"), "law", "doc").orderBy("seq").collect()
    assert [(r.node_id, r.text, r.source_number, r.source_year) for r in got] == [("art:7.par:2", "um", None, None), ("art:7.par:2", "dois", "15321", 2012)]


def test_bad_pages_are_rejected_whole(spark, tmp_path):
    row = {"idNorma": "1", "tipo": "Lei", "nuNorma": "1", "data": "09/03/1987", "nomeNorma": "Lei nº 1"}
    page = lambda n, rows, **more: {"number": n, "totalElements": 9, "totalPages": 3, "content": rows} | more
    good = json.dumps(page(0, [row, row | {"idNorma": "2"}]))
    bodies = {0: good, 1: json.dumps(page(1, [row]))[:-30], 2: {"error": "busy"}, 3: page(8, [row]), 4: page(4, [row, row]), 5: page(5, [row, "x"]), 6: page(6, [], totalPages=None), 7: page(7, []), 8: " ", 9: page(9, {"0": row}), 10: "[1]"}
    for n, body in bodies.items():
        put(tmp_path, f"page={n}.json", body)
    path = f"file://{tmp_path}/*.json"
    landed = L.pages(spark, path, C.ALESP, r"page=(\d+)", True)
    got = {int(r.file.rsplit("=", 1)[1][:-5]): r.reject for r in landed.collect()}
    assert got == {0: None, 1: "broken", 2: "no_list,page,total", 3: "page", 4: "repeated", 5: "record", 6: "total", 7: None, 8: "broken", 9: "no_list", 10: "no_list,page,total"}
    rows = C.alesp(spark, path, r"page=(\d+)", True).collect()
    assert sorted(r.remote_id for r in rows if r.reject is None) == ["1", "2"]
    assert sorted(r.reject for r in rows if r.reject) == sorted(f"page:{x}" for x in got.values() if x) and all(r.title == "" for r in rows if r.reject)
    kept = {r.file.rsplit("=", 1)[1]: r.value for r in L.quarantined(landed).collect()}
    assert len(kept) == 9 and kept["1.json"] == bodies[1]
    # without a number to hold it against, only what makes a page unreadable counts
    assert {r.reject for r in C.alesp(spark, f"file://{tmp_path}/page=[012].json").collect()} == {None, "page:broken", "page:no_list"}


def test_sinj_and_sapl_pages_fail_closed(spark, tmp_path):
    types = spark.createDataFrame([("1", "Lei")], "id string, law_type string")
    put(tmp_path, "a.json", {"pagination": {"page": 1}, "results": [{"id": 1, "tipo": 1, "ano": 1999}, {"id": 1, "tipo": 1, "ano": 1999}]})
    assert [(r.remote_id, r.reject) for r in C.sapl(spark, f"file://{tmp_path}/a.json", types).collect()] == [("", "page:repeated")]
    assert [r.reject for r in C.sinj(spark, f"file://{tmp_path}/a.json").collect()] == ["page:no_list"]


PROCESS = {"id": 77, "sigla": "PL", "numero": "12", "ano": 2009}


def entries_of(spark, fn, *docs):
    df = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "law long, doc string")
    return fn(df, "law", "doc").collect()


def test_lists_in_any_shape(spark):
    one, two = {"id": 1}, {"id": 2}
    docs = [[one, two], {"emendas": [one, two]}, {"dados": {"Emendas": {"Emenda": [one, two]}}}, {"Emenda": one}, one, [one, "x", 3, None, [two]], {"emendas": None}, {}, [], "no json", None, {"emendas": {"dados": []}}, "7"]
    got = {}
    for r in entries_of(spark, P.amendments, *docs):
        got.setdefault(r.law, []).append((r.seq, r.amendment_id))
    both = [(0, "1"), (1, "2")]
    assert {k: sorted(v) for k, v in got.items()} == {0: both, 1: both, 2: both, 3: both[:1], 4: both[:1], 5: both[:1]}


def test_processes_and_what_they_made(spark):
    docs = [{"processos": [PROCESS | {"normaGerada": {"siglaTipo": "LEI", "numero": "11.340", "anoAssinatura": "2006"}}]}, {"items": {"processo": PROCESS | {"normaGerada": "Lei Complementar nº 0.095-2 de 26/02/1998"}}}, [PROCESS | {"normaGerada": "sem número"}], PROCESS]
    got = [(r.process_id, r.norm_type, r.norm_number, r.norm_year) for r in sorted(entries_of(spark, P.processes, *docs), key=lambda r: r.law)]
    assert got == [("77", "LEI", "11340", 2006), ("77", "lei complementar", "95-2", 1998), ("77", None, None, None), ("77", None, None, None)]


def test_committee_sessions_in_any_shape(spark):
    ballot = {"NomeParlamentar": "A", "Voto": "Sim"}
    session = lambda votes: {"SiglaColegiado": "CCJ", "Votos": votes}
    docs = [{"VotacoesComissao": {"Votacoes": {"Votacao": session({"Voto": ballot})}}}, {"Votacoes": [session([ballot, ballot])]}, {"VotacoesComissao": {"Votacoes": [session(None)]}}, {"VotacoesComissao": {}}, []]
    got = {}
    for r in entries_of(spark, P.committee_votes, *docs):
        got.setdefault(r.law, []).append((r.committee, r.member, r.vote))
    assert got == {0: [("CCJ", "A", "Sim")], 1: [("CCJ", "A", "Sim")] * 2, 2: [("CCJ", None, None)]}


def test_raw_documents_below_a_folder(spark, tmp_path):
    """Files of any depth, without a glob that the driver would walk."""
    for name in ("one.txt", "a/two.txt", "a/b/three.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = C.raw_documents(spark, f"file://{tmp_path}").collect()
    assert sorted(bytes(r.raw_body).decode() for r in got) == ["a/b/three.txt", "a/two.txt", "one.txt"]


def test_raw_documents_are_listed_and_written_by_a_set_number_of_tasks(spark, tmp_path):
    """A task a folder is mostly waiting; and short rows became one task's, which made and moved every file."""
    import re

    from normspark import plans

    for i in range(60):
        (tmp_path / f"in/{i}").mkdir(parents=True)
        (tmp_path / f"in/{i}/x.txt").write_text("x")
    sc, name = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)

    def tasks(group, run):
        """Tasks of each stage of the jobs that ``run`` starts."""
        sc.setJobGroup(group, group)
        try:
            out = run()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        status = sc.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
        return out, [s.numTasks for s in stages if s]

    got, listing = tasks("listing", lambda: C.raw_documents(spark, f"file://{tmp_path}/in"))
    assert got.count() == 60 and listing == [16] and spark.conf.get(name) == before
    spark.range(200).select("id").selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got, landing = tasks("landing", lambda: plans.queries()["a14_raw_documents"](spark, str(tmp_path)))
    assert got.count() == 200 and 4 in landing
    made = {re.search(r"part-(\d+)-", f).group(1) for f in got.inputFiles()}
    assert len(made) == 4
