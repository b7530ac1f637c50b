"""Account, client, push, upload and payment-error jobs."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlytics.functions.formats import digits_only, nonempty, slugify
from vendorlytics.operators.admission import quota_fill, quota_ok, unique_claims
from vendorlytics.sources.tables import AS_OF, Tables

# Fixed values (reference constants).
PRO_PLAN = "pro"
CLIENT_QUOTA = 20
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
UPLOAD_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp"}
CARD_CODE_CLASS = {
    "card_declined": "banco_rechazo",
    "insufficient_funds": "fondos_insuficientes",
    "expired_card": "tarjeta_vencida",
    "incorrect_cvc": "cvc_incorrecto",
    "invalid_cvc": "cvc_incorrecto",
    "incorrect_number": "numero_invalido",
    "invalid_number": "numero_invalido",
    "fraudulent": "fraude",
    "processing_error": "error_temporal",
}
CARD_OTHER_CLASS = "tarjeta_otro"
CARD_ERROR = "StripeCardError"
ERROR_TYPE_CLASS = {
    "StripeConnectionError": "sin_conexion",
    "StripeAuthenticationError": "configuracion",
    "StripeInvalidRequestError": "datos_pago",
    "StripeRateLimitError": "demasiadas_solicitudes",
}
REFUSED_CODE = "ECONNREFUSED"
GENERIC_CLASS = "generico"
# Fixture: failure codes and types assigned to 'error' events by event_id.
FIXTURE_CARD_CODES = ["card_declined", "insufficient_funds", "expired_card", "incorrect_cvc", "invalid_cvc",
                      "incorrect_number", "invalid_number", "fraudulent", "processing_error", "do_not_honor"]
FIXTURE_ERROR_TYPES = ["StripeConnectionError", "StripeAuthenticationError", "StripeInvalidRequestError",
                       "StripeRateLimitError", "StripeAPIError"]


def _lit_map(d: dict) -> F.Column:
    return F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


# -- W11 ------------------------------------------------------------------
def store_settings_requests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.read("supplier").select(
        k.alias("id"), k.alias("seq"),
        F.concat(F.lit("Store "), (k % 40).cast("string"), F.lit("!")).alias("store_slug"),
        F.concat(F.lit("+52 (55) "), k.cast("string")).alias("telefono"),
        F.when(k % 4 == 0, F.lit('{"theme":"dark"}')).alias("personalizacion"))


def apply_store_settings(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Store slug and phone (plan 'pro' only). The clean slug must not
    be held by another user at the time of the request; holders change as
    earlier requests are accepted, so outcomes are solved by ``fixpoint``.
    A user may send any number of requests."""
    req = req if req is not None else store_settings_requests(t)
    users = t.users()
    r = (req.join(users.select("id", "suscripcion_plan"), "id", "left")
         .withColumn("slug", slugify(F.col("store_slug")))
         .withColumn("phone", digits_only(F.col("telefono")))
         .withColumn("filled", nonempty(F.col("store_slug")) & nonempty(F.col("telefono")))
         .withColumn("pro", F.coalesce(F.col("suscripcion_plan"), F.lit("mini")) == PRO_PLAN))
    base = r.select(
        F.col("seq").alias("req"), F.col("id").alias("owner"), "seq", F.col("slug").alias("value"),
        (F.col("filled") & F.col("pro")).alias("pre_ok"), F.lit(True).alias("post_ok"))
    holders = users.select(F.col("id").alias("h_owner"), F.col("store_slug").alias("h_value"))
    out = r.join(unique_claims(base, holders).withColumnRenamed("req", "seq"), "seq", "left")
    result = (F.when(~F.col("filled"), "datos_faltantes")
              .when(~F.col("pro"), "plan").when(~F.col("ok"), "slug_en_uso").otherwise("ok"))
    return out.select("id", "seq", result.alias("resultado"), F.col("slug").alias("store_slug"),
                      F.col("phone").alias("telefono"), *[c for c in ("store_name", "personalizacion") if c in req.columns])


def store_settings_apply(t: Tables) -> DataFrame:
    return apply_store_settings(t).select("id", "resultado", "store_slug", "telefono")


# -- W16 / W17 ------------------------------------------------------------
def user_requests(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.read("customer").select(
        k.alias("seq"), F.col("c_name").alias("nombre"),
        F.concat(F.lit("VENDOR"), (k % 200).cast("string"), F.lit("@example.com")).alias("email"),
        F.lit("x").alias("password"), (k % 3 + 1).cast("int").alias("rol_id"))


def decide_registrations(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """W16 self sign-up: trimmed name and e-mail required; e-mail trimmed and
    lower-cased; an e-mail already used (case-insensitive) or taken earlier
    in the batch is refused. New accounts: brand 1, role 2, 'pendiente'; the
    id is derived from the e-mail so reruns give the same ids."""
    req = req if req is not None else user_requests(t)
    valid = nonempty(F.trim("nombre")) & nonempty(F.trim("email")) & nonempty(F.col("password"))
    r = req.withColumn("valid", valid).withColumn("correo", F.lower(F.trim("email")))
    known = t.users().select(F.lower("email").alias("correo"), F.lit(True).alias("exists")).distinct()
    r = r.join(known, "correo", "left")
    win = r.where(F.col("valid") & F.col("exists").isNull()).groupBy("correo").agg(F.min("seq").alias("win"))
    r = r.join(win, "correo", "left")
    result = (F.when(~F.col("valid"), "datos_faltantes")
              .when(F.col("exists").isNotNull() | (F.col("win") < F.col("seq")), "correo_registrado").otherwise("ok"))
    return r.withColumn("resultado", result)


def register_users(t: Tables, req: DataFrame | None = None) -> DataFrame:
    ok = F.col("resultado") == "ok"
    return decide_registrations(t, req).select("seq", "resultado", F.when(ok, F.sha2("correo", 256)).alias("usuario_id"),
                    F.when(ok, F.col("correo")).alias("email"), F.when(ok, F.lit(1)).alias("marca_id"),
                    F.when(ok, F.lit(2)).alias("rol_id"), F.when(ok, F.lit("pendiente")).alias("suscripcion_estado"))


def decide_admin_users(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """W16 admin path: all fields required; brand NULL for role 1 (admin),
    else role - 1; the e-mail is stored as sent and must be unique."""
    req = req if req is not None else user_requests(t)
    valid = nonempty(F.col("nombre")) & nonempty(F.col("email")) & nonempty(F.col("password")) & \
        F.col("rol_id").isNotNull() & (F.col("rol_id") != 0)
    known = t.users().select("email", F.lit(True).alias("exists")).distinct()
    r = req.withColumn("valid", valid).join(known, "email", "left")
    win = r.where(F.col("valid") & F.col("exists").isNull()).groupBy("email").agg(F.min("seq").alias("win"))
    r = r.join(win, "email", "left")
    result = (F.when(~F.col("valid"), "datos_faltantes")
              .when(F.col("exists").isNotNull() | (F.col("win") < F.col("seq")), "correo_registrado").otherwise("ok"))
    return r.withColumn("resultado", result)


def create_users_admin(t: Tables, req: DataFrame | None = None) -> DataFrame:
    ok = F.col("resultado") == "ok"
    return decide_admin_users(t, req).select("seq", "resultado",
                    F.when(ok, F.sha2(F.col("email"), 256)).alias("usuario_id"),
                    F.when(ok, F.when(F.col("rol_id") == 1, F.lit(None)).otherwise(F.col("rol_id") - 1))
                    .cast("int").alias("marca_id"),
                    F.when(ok, F.col("rol_id")).alias("rol_id"))


def soft_delete_requests(t: Tables) -> DataFrame:
    """Fixture: every customer row asks for user (key * 37) % 1000 (most of
    those ids do not exist and change nothing)."""
    return t.read("customer").select(((F.col("c_custkey") * 37) % 1000).alias("id"))


def user_soft_delete(t: Tables, req: DataFrame | None = None, now: dt.date = AS_OF) -> DataFrame:
    """Cancel and expire the requested accounts (``req``: id); history
    is kept."""
    req = req if req is not None else soft_delete_requests(t)
    u = t.users().join(req.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    return u.select("id", F.when(F.col("hit").isNotNull(), "cancelada").otherwise(F.col("suscripcion_estado"))
                    .alias("suscripcion_estado"),
                    F.when(F.col("hit").isNotNull(), F.lit(now)).otherwise(F.col("suscripcion_fin"))
                    .alias("suscripcion_fin"))


# -- W18 / W19 / W20 ------------------------------------------------------
def client_requests(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.read("customer").select(
        k.alias("seq"), (k % 100).alias("vendedor_id"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("nombre"),
        F.lit(None).cast("string").alias("detalles"))


def decide_clients(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None,
                   quota: int = CLIENT_QUOTA) -> DataFrame:
    """Name required (400) before the client quota of plan 'mini' (403);
    a vendor without a plan is 'mini'. Accepted = first ``cap`` valid
    requests of each limited vendor."""
    req = req if req is not None else client_requests(t)
    snapshot = snapshot if snapshot is not None else t.clients().where(F.lit(False))
    held = snapshot.groupBy("vendedor_id").agg(F.count(F.lit(1)).alias("held"))
    plans = t.users().select(F.col("id").alias("vendedor_id"), "suscripcion_plan")
    r = (req.join(plans, "vendedor_id", "left").join(held, "vendedor_id", "left")
         .withColumn("valid", nonempty(F.col("nombre")))
         .withColumn("limited", F.coalesce("suscripcion_plan", F.lit("mini")) == "mini")
         .withColumn("cap", F.lit(quota) - F.coalesce("held", F.lit(0))))
    fill = quota_fill(r.where(F.col("valid") & F.col("limited") & (F.col("cap") > 0)), "vendedor_id", ["seq"],
                      "cap", quota)
    r = r.join(fill, "vendedor_id", "left")
    result = (F.when(~F.col("valid"), "datos_faltantes")
              .when(~quota_ok(F.col("limited"), F.col("cap"), F.col("fill"), ["seq"]), "cuota").otherwise("ok"))
    return r.withColumn("resultado", result)


def client_admission(t: Tables, req: DataFrame | None = None, snapshot: DataFrame | None = None,
                     quota: int = CLIENT_QUOTA) -> DataFrame:
    return decide_clients(t, req, snapshot, quota).select(
        "seq", "vendedor_id", "resultado", F.when(F.col("resultado") == "ok", F.coalesce("detalles", F.lit("{}"))).alias("detalles"))


def client_patch_requests(t: Tables) -> DataFrame:
    c = t.clients()
    m = F.col("id") % 3
    return c.select(
        "id", F.col("id").alias("seq"),
        F.when(F.col("id") % 17 == 0, F.col("vendedor_id") + 1).otherwise(F.col("vendedor_id")).alias("vendedor_id"),
        F.when(m == 0, F.lit(None).cast("string")).otherwise(F.concat(F.col("nombre"), F.lit(" *"))).alias("nombre"),
        F.when(m == 1, F.lit(None).cast("date")).otherwise(F.date_add("fecha_proximo_pago", 7))
        .alias("fecha_proximo_pago"),
        F.when(m == 2, F.lit('{"talla":"7"}')).alias("detalles"))


def client_patch(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Name: COALESCE(new, old); detalles: the sent value or '{}' (the
    reference always sends one); next payment date: overwritten, NULL too.
    Several edits of one client: the last one wins per column."""
    req = req if req is not None else client_patch_requests(t)
    c = t.clients().withColumn("detalles", F.lit(None).cast("string"))
    owned = c.select("id", "vendedor_id", F.lit(True).alias("owned"))
    r = req.join(owned, ["id", "vendedor_id"], "left")
    seq = F.col("seq")
    upd = r.where(F.col("owned")).groupBy("id").agg(
        F.max_by("nombre", F.when(F.col("nombre").isNotNull(), seq)).alias("n_nombre"),
        F.max_by(F.coalesce("detalles", F.lit("{}")), seq).alias("n_detalles"),
        F.max_by("fecha_proximo_pago", seq).alias("n_fecha"),
        F.lit(True).alias("hit"))
    j = c.join(upd, "id", "left")
    hit = F.col("hit").isNotNull()
    return j.select("id", F.when(hit, "ok").otherwise("sin_cambios").alias("resultado"),
                    F.coalesce("n_nombre", "nombre").alias("nombre"),
                    F.when(hit, F.col("n_detalles")).otherwise(F.col("detalles")).alias("detalles"),
                    F.when(hit, F.col("n_fecha")).otherwise(F.col("fecha_proximo_pago")).alias("fecha_proximo_pago"))


def client_delete(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Refuse while the client owes money; else unlink her sales
    (clienta_id -> NULL, history kept) and delete her."""
    c = t.clients()
    req = req if req is not None else c.select("id", "vendedor_id")
    r = req.join(c.select("id", "vendedor_id", "saldo_pendiente", F.lit(True).alias("found")),
                 ["id", "vendedor_id"], "left")
    result = (F.when(F.col("found").isNull(), "no_encontrada").when(F.col("saldo_pendiente") > 0, "saldo_pendiente")
              .otherwise("eliminada"))
    linked = t.sales().where(F.col("clienta_id").isNotNull()).groupBy(F.col("clienta_id").alias("id")) \
        .agg(F.count(F.lit(1)).alias("n"))
    r = r.withColumn("resultado", result).join(linked, "id", "left")
    return r.select("id", "resultado", F.when(F.col("resultado") == "eliminada", F.coalesce("n", F.lit(0)))
                    .otherwise(0).cast("bigint").alias("ventas_desvinculadas"))


# -- W21 / W22 / W23 ------------------------------------------------------
def push_requests(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("vendedor_id"),
                                   F.concat(F.lit("https://push.example/"), F.col("user_id").cast("string"))
                                   .alias("endpoint"))


def push_subscribe(t: Tables, req: DataFrame | None = None) -> DataFrame:
    """Plan 'pro' only; a (vendor, endpoint) already stored, or stored
    earlier in the batch, is not stored again. ``req``: seq, vendedor_id,
    endpoint."""
    req = req if req is not None else push_requests(t)
    plans = t.users().select(F.col("id").alias("vendedor_id"), "suscripcion_plan")
    have = t.push().select("vendedor_id", F.get_json_object("subscription", "$.endpoint").alias("endpoint"),
                           F.lit(True).alias("stored"))
    r = req.join(plans, "vendedor_id", "left").join(have, ["vendedor_id", "endpoint"], "left")
    pro = F.coalesce(F.col("suscripcion_plan") == PRO_PLAN, F.lit(False))
    first = r.where(pro & F.col("stored").isNull()).groupBy("vendedor_id", "endpoint").agg(F.min("seq").alias("first"))
    r = r.join(first, ["vendedor_id", "endpoint"], "left")
    result = F.when(~pro, "sin_plan").when(F.col("stored").isNotNull() | (F.col("first") < F.col("seq")), "existente") \
        .otherwise("insertada")
    return r.select("seq", "vendedor_id", "endpoint", result.alias("resultado"))


def upload_requests(t: Tables) -> DataFrame:
    types = list(UPLOAD_TYPES) + ["image/gif", "application/pdf"]
    return t.read("events").select(
        "event_id", "user_id", _pick(types, F.col("event_id") % 5).alias("content_type"),
        F.floor(F.col("value") * 20000).cast("bigint").alias("size"))


def check_uploads(req: DataFrame) -> DataFrame:
    """Allowed content type (400), 0 < size <= 5 MiB (413); the object
    key is uploads/<user>/<request id><ext>. ``req``: event_id, user_id,
    content_type, size; the size is kept for sums without another join."""
    ext = F.try_element_at(_lit_map(UPLOAD_TYPES), F.col("content_type"))
    status = (F.when(ext.isNull(), 400)
              .when(F.col("size").isNull() | (F.col("size") <= 0) | (F.col("size") > MAX_UPLOAD_BYTES), 413)
              .otherwise(200))
    key = F.concat(F.lit("uploads/"), F.col("user_id").cast("string"), F.lit("/"),
                   F.col("event_id").cast("string"), ext)
    return req.select("event_id", "user_id", "size", status.alias("estado"),
                      F.when(status == 200, key).alias("storage_key"))


def upload_manifest_check(t: Tables, req: DataFrame | None = None) -> DataFrame:
    return check_uploads(req if req is not None else upload_requests(t)).drop("size")


def upload_bytes_by_user(t: Tables, req: DataFrame | None = None) -> DataFrame:
    ok = check_uploads(req if req is not None else upload_requests(t)).where(F.col("estado") == 200)
    return ok.groupBy("user_id").agg(F.count(F.lit(1)).alias("subidas"), F.sum("size").alias("bytes"))


def payment_errors(t: Tables) -> DataFrame:
    """Fixture: failed payments ('error' events) with a failure type and code."""
    e = t.read("events").where(F.col("event_type") == "error")
    card = F.col("event_id") % 20 < 10
    return e.select("event_id", "ts",
                    F.when(card, F.lit(CARD_ERROR)).otherwise(_pick(FIXTURE_ERROR_TYPES, F.col("event_id") % 5))
                    .alias("tipo"),
                    F.when(card, _pick(FIXTURE_CARD_CODES, F.col("event_id") % 10))
                    .when(F.col("event_id") % 20 == 17, F.lit(REFUSED_CODE)).alias("codigo"))


def classify_payment_error(tipo, codigo) -> F.Column:
    """Message class of a failure: no connection (by type or code) first, then
    card codes, then the other types."""
    return (F.when(F.coalesce(codigo == REFUSED_CODE, F.lit(False)), F.lit(ERROR_TYPE_CLASS["StripeConnectionError"]))
            .when(tipo == CARD_ERROR, F.coalesce(F.try_element_at(_lit_map(CARD_CODE_CLASS), codigo),
                                                    F.lit(CARD_OTHER_CLASS)))
            .otherwise(F.coalesce(F.try_element_at(_lit_map(ERROR_TYPE_CLASS), tipo), F.lit(GENERIC_CLASS))))


def payment_error_summary(t: Tables, errors: DataFrame | None = None) -> DataFrame:
    """Failures per message class and day (``errors``: ts, tipo, codigo)."""
    e = errors if errors is not None else payment_errors(t)
    return (e.select(F.to_date("ts").alias("dia"), classify_payment_error(F.col("tipo"), F.col("codigo")).alias("clase"))
            .groupBy("dia", "clase").agg(F.count(F.lit(1)).alias("fallos")))


QUERIES = {
    "store_settings_apply": store_settings_apply,
    "user_register": register_users,
    "user_create": create_users_admin,
    "user_soft_delete": user_soft_delete,
    "client_admission": client_admission,
    "client_patch": client_patch,
    "client_delete": client_delete,
    "push_subscribe": push_subscribe,
    "upload_manifest_check": upload_manifest_check,
    "upload_bytes_by_user": upload_bytes_by_user,
    "payment_error_summary": payment_error_summary,
}
