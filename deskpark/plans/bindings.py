"""Bindings of the operators to the fixture views (the ``queries()`` keys)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpark.operators import appends as AP
from deskpark.operators import commands as CM
from deskpark.operators import escalation as ES
from deskpark.operators import hydrate as H
from deskpark.operators import identity as ID
from deskpark.operators import inbox as I
from deskpark.operators import intake as IN
from deskpark.operators import retrieval as RT
from deskpark.operators import services as SV
from deskpark.operators import tickets as T
from deskpark.operators import transcripts as TR
from deskpark.operators import triage as TG
from deskpark.plans.materialize import materialize
from deskpark.plans.registry import register
from deskpark.session import checkpoint_dir
from deskpark.sources.appends import AppendTables
from deskpark.sources.fixtures import DEFAULT_ASSIGNEE, DEFAULT_CLIENT, TestData


@register("analyst_inbox")
def analyst_inbox(d: TestData) -> DataFrame:
    return I.analyst_inbox(d.inbox_req, d.ticket, d.analista, d.colaborador, d.external, d.cliente,
                           d.cliente_servicio, d.servicio)


@register("ticket_hydrate")
def ticket_hydrate(d: TestData) -> DataFrame:
    return H.hydrate_page(d.ticket, d.colaborador, d.external, d.cliente, d.cliente_servicio, d.servicio)


@register("latest_escalation")
def latest_escalation(d: TestData) -> DataFrame:
    return H.latest_escalation(d.escalado)


@register("transcripts")
def transcripts(d: TestData) -> DataFrame:
    return TR.transcripts(d.mensaje)


@register("transcript_parts")
def transcript_parts(d: TestData) -> DataFrame:
    return TR.transcript_parts(d.mensaje)


@register("ticket_detail")
def ticket_detail(d: TestData) -> DataFrame:
    return H.ticket_detail(d.ticket, d.colaborador, d.external, d.cliente, d.cliente_servicio, d.servicio,
                           d.escalado, TR.transcripts(d.mensaje))


@register("ticket_cards")
def ticket_cards(d: TestData) -> DataFrame:
    return H.ticket_cards(d.ticket, d.analista, d.external, d.cliente_servicio, d.servicio)


def _cards_of(d: TestData):
    return lambda t: H.ticket_cards(t, d.analista, d.external, d.cliente_servicio, d.servicio)


@register("open_tickets")
def open_tickets(d: TestData) -> DataFrame:
    return T.open_tickets(d.ticket, d.owner_req)


@register("all_tickets")
def all_tickets(d: TestData) -> DataFrame:
    return T.all_tickets(d.ticket, d.owner_req)


@register("ticket_lookup_owned")
def ticket_lookup_owned(d: TestData) -> DataFrame:
    return T.lookup_owned(d.lookup_req, d.ticket, _cards_of(d))


@register("tickets_by_subject")
def tickets_by_subject(d: TestData) -> DataFrame:
    return T.tickets_by_subject(d.ticket, d.search_req)


@register("subject_digest")
def subject_digest(d: TestData) -> DataFrame:
    return T.subject_digest(d.search_req, d.ticket, _cards_of(d))


@register("ticket_digest")
def ticket_digest(d: TestData) -> DataFrame:
    return T.ticket_digest(d.owner_req, d.ticket, _cards_of(d))


@register("recent_tickets")
def recent_tickets(d: TestData) -> DataFrame:
    return T.recent_tickets(d.ticket, d.owner_req)


@register("urgency_summary")
def urgency_summary(d: TestData) -> DataFrame:
    return T.urgency_summary(d.ticket, d.owner_req)


@register("sla_due")
def sla_due(d: TestData) -> DataFrame:
    return T.sla_due(d.ticket)


ASSIGNEE_QUERY_NAME = DEFAULT_ASSIGNEE.upper()  # matched in another letter case


@register("client_services")
def client_services(d: TestData) -> DataFrame:
    return SV.client_services(d.cliente_servicio, d.servicio)


@register("service_resolve")
def service_resolve(d: TestData) -> DataFrame:
    return SV.service_resolve(d.intake_req, d.cliente_servicio, d.servicio)


@register("service_list_parts")
def service_list_parts(d: TestData) -> DataFrame:
    return SV.service_list_parts(d.cliente, d.cliente_servicio, d.servicio)


@register("user_context")
def user_context(d: TestData) -> DataFrame:
    return SV.user_context(d.login, d.external, d.colaborador, d.cliente, d.cliente_servicio, d.servicio, DEFAULT_CLIENT)


@register("identity_upsert")
def identity_upsert(d: TestData) -> DataFrame:
    return ID.identity_upsert(d.external, d.login)


@register("identity_duplicates")
def identity_duplicates(d: TestData) -> DataFrame:
    return ID.identity_duplicates(d.external)


@register("role_collaborator")
def role_collaborator(d: TestData) -> DataFrame:
    return ID.role_collaborator(ID.login_personas(d.external, d.login), d.colaborador, d.cliente, DEFAULT_CLIENT)


@register("role_analyst")
def role_analyst(d: TestData) -> DataFrame:
    return ID.role_analyst(ID.login_personas(d.external, d.login), d.analista)


@register("default_assignee")
def default_assignee(d: TestData) -> DataFrame:
    return ID.default_assignee(d.external, d.analista, ASSIGNEE_QUERY_NAME)


@register("normalize_status")
def normalize_status(d: TestData) -> DataFrame:
    return CM.normalize_status(d.status_cmd)


@register("normalize_level")
def normalize_level(d: TestData) -> DataFrame:
    return CM.normalize_level(d.status_cmd)


@register("status_validate")
def status_validate(d: TestData) -> DataFrame:
    return CM.status_validate(d.status_cmd, d.analista, d.ticket)


@register("status_apply")
def status_apply(d: TestData) -> DataFrame:
    return CM.status_apply(d.ticket, CM.status_validate(d.status_cmd, d.analista, d.ticket))


@register("escalation_candidates")
def escalation_candidates(d: TestData) -> DataFrame:
    return ES.escalation_candidates(d.escalation_cmd, d.analista)


@register("escalation_validate")
def escalation_validate(d: TestData) -> DataFrame:
    return ES.escalation_validate(d.escalation_cmd, d.analista, d.ticket)


@register("escalation_apply")
def escalation_apply(d: TestData) -> DataFrame:
    return ES.escalation_apply(d.ticket, ES.escalation_validate(d.escalation_cmd, d.analista, d.ticket))


@register("escalation_log")
def escalation_log(d: TestData) -> DataFrame:
    return ES.escalation_log(d.escalado, ES.escalation_validate(d.escalation_cmd, d.analista, d.ticket))


def _intake(d: TestData) -> DataFrame:
    return IN.ticket_intake(d.intake_req, d.ticket, d.cliente_servicio, d.servicio, d.external, d.analista,
                            ASSIGNEE_QUERY_NAME)


@register("ticket_intake")
def ticket_intake(d: TestData) -> DataFrame:
    return _intake(d)


@register("intake_conversations")
def intake_conversations(d: TestData) -> DataFrame:
    return TR.intake_conversations(_intake(d), d.mensaje.withColumnRenamed("id_ticket", "thread_id"))


def _appended(d: TestData) -> AppendTables:
    """New tables in a folder of their own under the shared checkpoint folder."""
    return AppendTables(d.spark, f"{checkpoint_dir(d.spark).rstrip('/')}/appended-{uuid.uuid4().hex}", AP.TABLES)


@register("ticket_append")
def ticket_append(d: TestData) -> DataFrame:
    """The tickets of the intake batch, read back from the table's files after the batch was run twice."""
    tables, intake = _appended(d), materialize(_intake(d))
    for _ in range(2):
        AP.append_intake(tables, "intake-1", intake, d.mensaje.withColumnRenamed("id_ticket", "thread_id"))
    return tables.read("ticket")


@register("conversation_append")
def conversation_append(d: TestData) -> DataFrame:
    """The conversations of the intake batch, read back from the table's files; the array of turns as JSON."""
    tables, intake = _appended(d), materialize(_intake(d))
    AP.append_intake(tables, "intake-1", intake, d.mensaje.withColumnRenamed("id_ticket", "thread_id"))
    return tables.read("conversacion").select("id_ticket", F.to_json("contenido").alias("contenido"))


@register("escalation_append")
def escalation_append(d: TestData) -> DataFrame:
    """The log rows of the escalation batch, read back from the table's files."""
    tables = _appended(d)
    AP.append_escalations(tables, "escalations-1", ES.escalation_log(d.escalado, ES.escalation_validate(d.escalation_cmd, d.analista, d.ticket)))
    return tables.read("escalado")


@register("ticket_receipts")
def ticket_receipts(d: TestData) -> DataFrame:
    return IN.ticket_receipts(_intake(d))


@register("kb_topk")
def kb_topk(d: TestData) -> DataFrame:
    return RT.kb_topk(d.kb_document, d.kb_question)


@register("kb_context")
def kb_context(d: TestData) -> DataFrame:
    return RT.kb_context(d.kb_document, d.kb_question)


@register("kb_unanswered")
def kb_unanswered(d: TestData) -> DataFrame:
    return RT.kb_unanswered(d.kb_document, d.kb_question)


@register("triage_type")
def triage_type(d: TestData) -> DataFrame:
    return TG.triage_type(d.mensaje)


@register("triage_urgency")
def triage_urgency(d: TestData) -> DataFrame:
    return TG.triage_urgency(d.mensaje)
