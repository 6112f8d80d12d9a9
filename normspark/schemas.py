"""Explicit schemas of the landed payloads; nothing is inferred."""

SENATE_LIST = "_id string, tipo string, descricao string, numero string, norma string, normaNome string, ementa string, dataassinatura string, anoassinatura string, apelido string"

SENATE_DETAIL = (
    "identificacao struct<numero:string,reedicao:string,normaNome:string>, "
    "disps struct<disp:array<struct<nomeDispositivo:string,refs:struct<ref:array<struct<comentario:string,codNormaPosterior:string,dispositivo:string,datAssinatura:string,datapub:string>>>>>>"
)

ALESP_PAGE = "number int, size int, totalElements int, content array<struct<idNorma:string,tipo:string,nuNorma:string,data:string,dataPublicacao:string,nomeNorma:string,idTipo:string,dsEmenta:string,urlIntegraListaPesquisa:string>>"

_NOTE = "array<struct<tipoAnotacao:string,idNormaAnotadora:string,idAnotacao:string,anotadoraDsUrl:string,nomeNorma:string,anotadoraTpNorma:string,anotadoraNuNorma:string,anotadoraTxNorma:string,anotadoraDtNorma:string,dataOrdenacao:string,anotadoraDtPublicacao:string>>"
ALESP_DETAIL = f"idNorma string, anotacoesAlteracao {_NOTE}, anotacaoOutras {_NOTE}"

SAPL_PAGE = "pagination struct<page:int,total_entries:int,total_pages:int>, results array<struct<id:string,tipo:string,numero:string,ano:string,data:string,data_publicacao:string,esfera_federacao:string,__str__:string,ementa:string,texto_integral:string>>"

SAPL_RELATIONS = "results array<struct<id:string,norma_principal:string,norma_relacionada:string,tipo_vinculo:string,resumo:string,__str__:string>>"

SINJ_PAGE = (
    "iTotalDisplayRecords int, aaData array<struct<_id:string,_source:struct<ch_norma:string,nm_tipo_norma:string,nr_norma:string,dt_assinatura:string,ds_ementa:string,nm_situacao:string,"
    "fontes:array<struct<dt_publicacao:string,ar_fonte:struct<mimetype:string>>>,ar_atualizado:struct<mimetype:string>>>>"
)

SINJ_RELATIONS = (
    "vides array<struct<in_norma_afetada:boolean,ds_texto_relacao:string,nm_tipo_relacao:string,ch_vide:string,ch_norma_vide:string,nm_tipo_norma_vide:string,nr_norma_vide:string,"
    "dt_assinatura_norma_vide:string,artigo_norma_vide:string,paragrafo_norma_vide:string,inciso_norma_vide:string,alinea_norma_vide:string,anexo_norma_vide:string>>"
)

_UF = "struct<sigla:string>"
IBGE_PLACE = f"id string, nome string, sigla string, microrregiao struct<mesorregiao:struct<UF:{_UF}>>, `regiao-imediata` struct<`regiao-intermediaria`:struct<UF:{_UF}>>"

JOB_EVENT = "event_id string, job_id string, status string, at timestamp, lease_until timestamp"
