"""DuckDB statements that give the same rows as the registered queries."""

from __future__ import annotations

from marlstone.functions.text import FORBIDDEN_SQL, INJECTION_PATTERNS, INTENTS, LABELLED, LABEL_STOP_WORDS, PII_PATTERNS
from marlstone.operators.ontology import CLASSES, ENTITIES, schema_of
from marlstone.operators.catalog import SUITES
from marlstone.plans.model import CUBES
from marlstone.operators.ontology import GROUNDINGS
from marlstone.plans.retrieve import cube_text
from marlstone.queries import DECLARED, MODELS, PROMPTS, SAMPLES, STATEMENTS
from marlstone.sources.bindings import LOGICAL, with_logical
from marlstone.sources.contracts import ALLOWED

ORACLES: dict[str, str] = {}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, *columns: str) -> str:
    cell = lambda v: "NULL" if v is None else _text(v) if isinstance(v, str) else repr(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) t({', '.join(columns)}))"


def _sum(expr: str, where: str = "") -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,4))){f' FILTER (WHERE {where})' if where else ''} AS DOUBLE)"


def _avg(expr: str, where: str = "") -> str:
    keep = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,4))){keep} AS DOUBLE) / nullif(count({expr}){keep}, 0)"


def _ratio(a: str, b: str) -> str:
    return f"100.0::DOUBLE * CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def _add(name: str, sql: str, *tables: str) -> None:
    ORACLES[name] = with_logical(sql, *tables) if tables else sql


def _grouped(name: str, source: str, tables: tuple[str, ...], keys: dict[str, str], out: dict[str, str]) -> None:
    head = ", ".join([f"{e} AS {c}" for c, e in keys.items()] + [f"{e} AS {c}" for c, e in out.items()])
    _add(name, f"SELECT {head} FROM {source}" + (f" GROUP BY {', '.join(keys.values())}" if keys else ""), *tables)


_DA, _LA, _PC = "deposit_account", "loan_agreement", "party_role_customer"
_ACC = "deposit_account a LEFT JOIN deposit_balance b ON a.deposit_account_id = b.deposit_account_id AND b.md_is_active"
_grouped("sem_deposit_accounts_by_type", _ACC, (_DA, "deposit_balance"), {"deposit_account_account_type": "a.account_type"}, {"deposit_account_total_deposit_accounts": "count(*) FILTER (WHERE a.md_is_active)", "deposit_account_total_available_balance": _sum("b.available_balance"), "deposit_account_total_ledger_balance": _sum("b.ledger_balance")})
_grouped("sem_overdrawn_count_amount", _ACC, (_DA, "deposit_balance"), {"deposit_account_currency_code": "a.currency_code"}, {"deposit_account_overdrawn_account_count": "count(*) FILTER (WHERE b.current_balance < 0 AND a.md_is_active)", "deposit_account_total_overdrawn_amount": _sum("CASE WHEN b.current_balance < 0 THEN abs(b.current_balance) ELSE 0 END"), "deposit_account_total_accrued_interest": _sum("b.accrued_interest")})
_grouped("sem_balance_totals", "deposit_balance b LEFT JOIN deposit_account a ON a.deposit_account_id = b.deposit_account_id", (_DA, "deposit_balance"), {"deposit_balance_currency_code": "b.currency_code", "deposit_account_account_type": "a.account_type"}, {f"deposit_balance_total_{k}": _sum(f"b.{k}") for k in ("current_balance", "available_balance", "ledger_balance", "accrued_interest")})
_grouped("sem_avg_balance", _ACC, (_DA, "deposit_balance"), {"deposit_account_account_type": "a.account_type"}, {"deposit_account_average_account_balance": _avg("b.available_balance")})
_grouped("sem_loan_exposure_by_status", _LA, (_LA,), {"loan_agreement_agreement_status": "agreement_status"}, {"loan_agreement_total_loan_contracts": "count(*) FILTER (WHERE md_is_active)", "loan_agreement_total_principal_exposure": _sum("principal_amount", "md_is_active"), "loan_agreement_average_loan_amount": _avg("principal_amount", "md_is_active")})
_NPL, _TOTAL = "count(*) FILTER (WHERE is_npl AND md_is_active)", "count(*) FILTER (WHERE md_is_active)"
_grouped("sem_npl_ratio", _LA, (_LA,), {"loan_agreement_currency_code": "currency_code"}, {"loan_agreement_npl_default_count": _NPL, "loan_agreement_npl_default_principal_exposure": _sum("principal_amount", "is_npl AND md_is_active"), "loan_agreement_npl_default_ratio": _ratio(_NPL, _TOTAL)})
_grouped("sem_avg_rate_unweighted", _LA, (_LA,), {"loan_agreement_agreement_status": "agreement_status"}, {"loan_agreement_average_interest_rate": _avg("interest_rate * 100")})
_LR = "loan_repayment_schedule"
_grouped("sem_collection_rate", _LR, (_LR,), {f"{_LR}_installment_status": "installment_status"}, {f"{_LR}_total_installments": "count(*)", f"{_LR}_total_scheduled_due": _sum("total_due"), f"{_LR}_total_collected_amount": _sum("paid_amount"), f"{_LR}_collection_fulfillment_rate": _ratio(_sum("paid_amount"), _sum("total_due"))})
_grouped("sem_overdue_exposure", _LR, (_LR,), {f"{_LR}_installment_number": "installment_number"}, {f"{_LR}_overdue_installment_count": "count(*) FILTER (WHERE installment_status = 'OVERDUE' AND md_is_active)", f"{_LR}_overdue_amount_exposure": _sum("CASE WHEN installment_status = 'OVERDUE' THEN total_due - paid_amount ELSE 0 END")})
_IN, _OUT = _sum("amount", "transaction_type IN ('DEPOSIT', 'TRANSFER_IN', 'INTEREST_CREDIT')"), _sum("amount", "transaction_type IN ('WITHDRAWAL', 'TRANSFER_OUT', 'FEE')")
_DT = "deposit_transaction"
_grouped("sem_net_cashflow", _DT, (_DT,), {f"{_DT}_transaction_status": "transaction_status"}, {f"{_DT}_total_transactions": "count(*)", f"{_DT}_total_deposit_volume": _IN, f"{_DT}_total_withdrawal_volume": _OUT, f"{_DT}_net_transaction_cashflow": f"round({_IN} - {_OUT}, 4)", f"{_DT}_average_transaction_amount": _avg("amount")})
_HIGH, _ALIVE = "count(*) FILTER (WHERE aml_risk_rating = 'HIGH' AND md_is_active)", "count(*) FILTER (WHERE md_is_active)"
_grouped("sem_high_aml_ratio", _PC, (_PC,), {f"{_PC}_customer_segment": "customer_segment"}, {f"{_PC}_total_customers": "count(*)", f"{_PC}_active_customers_count": _ALIVE, f"{_PC}_high_aml_risk_count": _HIGH, f"{_PC}_verified_kyc_count": "count(*) FILTER (WHERE kyc_status = 'VERIFIED' AND md_is_active)", f"{_PC}_high_aml_risk_ratio": _ratio(_HIGH, _ALIVE)})
_LC = "loan_collateral"
_grouped("sem_collateral_risk", _LC, (_LC,), {f"{_LC}_collateral_type": "collateral_type", f"{_LC}_collateral_status": "collateral_status"}, {f"{_LC}_total_collateral_assets": "count(*)", f"{_LC}_total_appraised_value": _sum("estimated_value"), f"{_LC}_average_ltv_ratio": _avg("ltv_ratio * 100"), f"{_LC}_high_ltv_risk_count": "count(*) FILTER (WHERE ltv_ratio > 0.80 AND md_is_active)"})
_LP = "loan_application"
_grouped("sem_applications", _LP, (_LP,), {f"{_LP}_application_status": "application_status"}, {f"{_LP}_total_applications": "count(*)", f"{_LP}_approved_application_count": "count(*) FILTER (WHERE application_status = 'APPROVED')", f"{_LP}_total_requested_principal": _sum("requested_amount"), f"{_LP}_average_credit_score": _avg("credit_score")})
_LD = "loan_disbursement"
_grouped("sem_disbursements", _LD, (_LD,), {f"{_LD}_disbursement_status": "disbursement_status"}, {f"{_LD}_total_disbursed_amount": _sum("disbursed_amount"), f"{_LD}_total_disbursements_count": "count(*)"})
_OF = "deposit_overdraft_facility"
_grouped("sem_overdraft_facilities", f"{_OF} o LEFT JOIN deposit_account a USING (deposit_account_id)", (_OF, _DA), {f"{_OF}_facility_status": "o.facility_status", "deposit_account_account_type": "a.account_type"}, {f"{_OF}_total_approved_limit": _sum("o.approved_limit"), f"{_OF}_total_facility_count": "count(*)"})
_grouped("sem_deposit_rates", "deposit_interest_term", ("deposit_interest_term",), {"deposit_interest_term_rate_type": "rate_type"}, {"deposit_interest_term_average_interest_rate": _avg("interest_rate * 100")})
_grouped("sem_party_masters", "party", ("party",), {"party_party_type": "party_type", "party_status_code": "status_code"}, {"party_total_party_masters": "count(*)"})
_add("sem_party_details", "SELECT (SELECT count(*) FROM party_address) AS party_address_total_addresses, (SELECT count(*) FROM party_identification) AS party_identification_total_identifications, (SELECT count(*) FROM party_individual) AS party_individual_total_individuals, (SELECT count(*) FROM party_organization) AS party_organization_total_organizations", "party_address", "party_identification", "party_individual", "party_organization")
_add("sem_reference_counts", "SELECT (SELECT count(*) FROM ref_country) AS ref_country_total_countries, (SELECT count(*) FILTER (WHERE is_high_risk_aml) FROM ref_country) AS ref_country_high_risk_aml_country_count, (SELECT count(*) FROM ref_currency) AS ref_currency_total_currencies, (SELECT count(*) FROM ref_nace_industry) AS ref_nace_industry_total_industries, (SELECT count(*) FILTER (WHERE risk_level = 'HIGH') FROM ref_nace_industry) AS ref_nace_industry_high_risk_industry_count", "ref_country", "ref_currency", "ref_nace_industry")
_SEG = "SELECT customer_segment AS customer_360_customer_segment, count(*) AS customer_360_total_customers FROM party_role_customer GROUP BY customer_segment"
_DEP = f"SELECT c.customer_segment AS customer_360_customer_segment, {_sum('b.available_balance')} AS customer_360_deposit_account_total_available_balance FROM {_ACC} LEFT JOIN party_role_customer c ON a.customer_id = c.party_role_customer_id GROUP BY 1"
_LOAN = f"SELECT c.customer_segment AS customer_360_customer_segment, {_sum('l.principal_amount', 'l.md_is_active')} AS customer_360_loan_agreement_total_principal_exposure FROM loan_agreement l LEFT JOIN party_role_customer c ON l.customer_id = c.party_role_customer_id GROUP BY 1"
_add("sem_view_customer360_deposit", f"SELECT * FROM ({_SEG}) FULL JOIN ({_DEP}) USING (customer_360_customer_segment)", _PC, _DA, "deposit_balance")
_add("sem_view_customer360_loan", f"SELECT c.customer_segment AS customer_360_customer_segment, c.aml_risk_rating AS customer_360_aml_risk_rating, {_sum('l.principal_amount', 'l.md_is_active')} AS customer_360_loan_agreement_total_principal_exposure, {_ratio('count(*) FILTER (WHERE l.is_npl AND l.md_is_active)', 'count(*) FILTER (WHERE l.md_is_active)')} AS customer_360_loan_agreement_npl_default_ratio FROM loan_agreement l LEFT JOIN party_role_customer c ON l.customer_id = c.party_role_customer_id GROUP BY 1, 2", _PC, _LA)
_add("sem_view_customer360_both", f"SELECT * FROM ({_SEG}) FULL JOIN ({_DEP}) USING (customer_360_customer_segment) FULL JOIN ({_LOAN}) USING (customer_360_customer_segment)", _PC, _DA, "deposit_balance", _LA)
_add("sem_filter_tree", f"SELECT l.currency_code AS loan_agreement_currency_code, count(*) FILTER (WHERE l.md_is_active) AS loan_agreement_total_loan_contracts, {_sum('l.principal_amount', 'l.md_is_active')} AS loan_agreement_total_principal_exposure FROM loan_agreement l LEFT JOIN party_role_customer c ON l.customer_id = c.party_role_customer_id WHERE l.agreement_status = 'ACTIVE' OR (l.is_npl AND c.customer_segment <> 'BUILDING') GROUP BY 1", _LA, _PC)
_add("sem_time_granularity", f"SELECT CAST(date_trunc('month', disbursement_date) AS DATE) AS loan_agreement_disbursement_date_month, count(*) FILTER (WHERE md_is_active) AS loan_agreement_total_loan_contracts, {_sum('principal_amount', 'md_is_active')} AS loan_agreement_total_principal_exposure FROM loan_agreement WHERE disbursement_date >= TIMESTAMP '1996-01-01' AND disbursement_date < TIMESTAMP '1998-01-01' GROUP BY 1", _LA)
_add("sem_multi_hop_industry", f"SELECT i.risk_level AS ref_nace_industry_risk_level, count(*) AS {_PC}_total_customers, count(*) FILTER (WHERE c.aml_risk_rating = 'HIGH' AND c.md_is_active) AS {_PC}_high_aml_risk_count FROM party_role_customer c LEFT JOIN party_organization o ON c.party_id = o.party_id LEFT JOIN ref_nace_industry i ON o.nace_code = i.nace_code GROUP BY 1", _PC, "party_organization", "ref_nace_industry")
_add("sem_multi_hop_loan_segment", f"SELECT c.customer_segment AS {_PC}_customer_segment, {_sum('k.estimated_value')} AS loan_collateral_total_appraised_value FROM loan_collateral k LEFT JOIN loan_agreement l USING (loan_agreement_id) LEFT JOIN party_role_customer c ON l.customer_id = c.party_role_customer_id GROUP BY 1", _LC, _LA, _PC)
_add("sem_to_many_dimension", f"SELECT agreement_status AS loan_agreement_agreement_status, count(DISTINCT party_role_customer_id) AS {_PC}_total_customers FROM party_role_customer c LEFT JOIN loan_agreement l ON l.customer_id = c.party_role_customer_id GROUP BY 1", _PC, _LA)
_add("sem_distinct_members", "SELECT DISTINCT account_type AS deposit_account_account_type, currency_code AS deposit_account_currency_code FROM deposit_account", _DA)
_add("sem_ordered_limit", "SELECT account_type AS deposit_account_account_type, currency_code AS deposit_account_currency_code, count(*) FILTER (WHERE md_is_active) AS deposit_account_total_deposit_accounts FROM deposit_account GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 4", _DA)
_add("sem_rollup_merged", f"SELECT agreement_status AS loan_agreement_agreement_status, count(*) FILTER (WHERE md_is_active) AS loan_agreement_total_loan_contracts, {_sum('principal_amount', 'md_is_active')} AS loan_agreement_total_principal_exposure, count(*) FILTER (WHERE is_npl AND md_is_active) AS loan_agreement_npl_default_count, {_sum('principal_amount', 'is_npl AND md_is_active')} AS loan_agreement_npl_default_principal_exposure FROM (SELECT principal_amount, md_is_active, CASE WHEN loan_agreement_id % 50 = 0 THEN 'PAID_OFF' ELSE agreement_status END AS agreement_status, is_npl AND loan_agreement_id % 50 <> 0 AS is_npl FROM loan_agreement WHERE loan_agreement_id % 97 <> 0) GROUP BY 1", _LA)
_add("sem_rollup_credit_risk", f"SELECT agreement_status AS loan_agreement_agreement_status, count(*) FILTER (WHERE md_is_active) AS loan_agreement_total_loan_contracts, {_sum('principal_amount', 'md_is_active')} AS loan_agreement_total_principal_exposure FROM loan_agreement WHERE NOT is_npl GROUP BY 1", _LA)
_add("sem_rollup_account_activity", f"SELECT a.currency_code AS deposit_account_currency_code, count(*) FILTER (WHERE a.md_is_active) AS deposit_account_total_deposit_accounts, count(*) FILTER (WHERE b.current_balance < 0 AND a.md_is_active) AS deposit_account_overdrawn_account_count FROM {_ACC} GROUP BY 1", _DA, "deposit_balance")
_add("sem_rollup_balance_totals", f"SELECT a.account_status AS deposit_account_account_status, {_sum('b.current_balance')} AS deposit_balance_total_current_balance FROM deposit_balance b LEFT JOIN deposit_account a USING (deposit_account_id) GROUP BY 1", _DA, "deposit_balance")
_add("sem_rollup_customer_risk", f"SELECT aml_risk_rating AS {_PC}_aml_risk_rating, count(*) AS {_PC}_total_customers, count(*) FILTER (WHERE kyc_status = 'VERIFIED' AND md_is_active) AS {_PC}_verified_kyc_count FROM party_role_customer GROUP BY 1", _PC)

_add("rel_collateral", f"SELECT collateral_type, count(*) AS asset_count, {_sum('estimated_value')} AS total_value FROM loan_collateral WHERE md_is_active GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10", _LC)
_add("rel_deposit", f"SELECT a.account_type, count(*) AS account_count, {_sum('b.available_balance')} AS total_available_balance FROM deposit_account a JOIN deposit_balance b USING (deposit_account_id) WHERE a.md_is_active AND b.md_is_active GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10", _DA, "deposit_balance")
_add("sem_repayments_by_collateral", f"SELECT collateral_status AS loan_collateral_collateral_status, count(*) AS loan_repayment_schedule_total_installments, {_sum('total_due')} AS loan_repayment_schedule_total_scheduled_due FROM (SELECT DISTINCT r.rid, r.total_due, c.collateral_status FROM (SELECT *, row_number() OVER () AS rid FROM loan_repayment_schedule) r LEFT JOIN loan_agreement a USING (loan_agreement_id) LEFT JOIN loan_collateral c ON c.loan_agreement_id = a.loan_agreement_id) GROUP BY 1", "loan_repayment_schedule", _LA, "loan_collateral")
_add("sem_maturity_by_year", "SELECT CAST(date_trunc('year', maturity_date) AS DATE) AS loan_agreement_maturity_date_year, count(*) FILTER (WHERE md_is_active) AS loan_agreement_total_loan_contracts FROM loan_agreement GROUP BY 1", _LA)
_add("sem_new_dimensions", "SELECT currency_code AS deposit_transaction_currency_code, transaction_type AS deposit_transaction_transaction_type, count(*) AS deposit_transaction_total_transactions FROM deposit_transaction GROUP BY 1, 2", "deposit_transaction")
_ACTIVE_COUNT = "count(*) FILTER (WHERE o.md_is_active)"
_OWN = {
    _DA: ("total_deposit_accounts", _ACTIVE_COUNT), "deposit_balance": ("total_current_balance", _sum("o.current_balance")), "deposit_interest_term": ("average_interest_rate", _avg("o.interest_rate * 100")), "deposit_overdraft_facility": ("total_facility_count", "count(*)"), "deposit_transaction": ("total_transactions", "count(*)"),
    _LA: ("total_loan_contracts", _ACTIVE_COUNT), "loan_application": ("total_applications", "count(*)"), "loan_collateral": ("total_collateral_assets", "count(*)"), "loan_disbursement": ("total_disbursements_count", "count(*)"), "loan_repayment_schedule": ("total_installments", "count(*)"),
    "party_address": ("total_addresses", "count(*)"), "party_identification": ("total_identifications", "count(*)"), "party_individual": ("total_individuals", "count(*)"), "party_organization": ("total_organizations", "count(*)"), _PC: ("total_customers", "count(*)"),
}
for _a, _b, _key, _their, _dim in (
    (_DA, _PC, "customer_id", "party_role_customer_id", "customer_segment"), (_DA, "deposit_balance", "deposit_account_id", "deposit_account_id", "currency_code"), (_DA, "ref_currency", "currency_code", "currency_code", "currency_name"), (_DA, "deposit_interest_term", "deposit_account_id", "deposit_account_id", "rate_type"),
    ("deposit_balance", _DA, "deposit_account_id", "deposit_account_id", "account_type"), ("deposit_interest_term", _DA, "deposit_account_id", "deposit_account_id", "account_type"), ("deposit_overdraft_facility", _DA, "deposit_account_id", "deposit_account_id", "account_type"), ("deposit_transaction", _DA, "deposit_account_id", "deposit_account_id", "account_type"),
    (_LA, _PC, "customer_id", "party_role_customer_id", "customer_segment"), (_LA, "loan_application", "loan_application_id", "loan_application_id", "application_status"), (_LA, "ref_currency", "currency_code", "currency_code", "currency_name"), ("loan_application", _PC, "customer_id", "party_role_customer_id", "customer_segment"),
    ("loan_collateral", _LA, "loan_agreement_id", "loan_agreement_id", "agreement_status"), ("loan_disbursement", _LA, "loan_agreement_id", "loan_agreement_id", "agreement_status"), ("loan_repayment_schedule", _LA, "loan_agreement_id", "loan_agreement_id", "agreement_status"),
    ("party_address", "party", "party_id", "party_id", "party_type"), ("party_identification", "party", "party_id", "party_id", "party_type"), ("party_individual", "party", "party_id", "party_id", "party_type"), ("party_individual", "ref_country", "citizenship_country_code", "country_code", "country_name"),
    ("party_organization", "party", "party_id", "party_id", "party_type"), ("party_organization", "ref_country", "incorporation_country_code", "country_code", "country_name"), ("party_organization", "ref_nace_industry", "nace_code", "nace_code", "nace_title"),
    (_PC, "party", "party_id", "party_id", "party_type"), (_PC, "party_individual", "party_id", "party_id", "first_name"), (_PC, "party_organization", "party_id", "party_id", "legal_form"),
):
    _live = " AND t.md_is_active" if (_a, _b) in ((_DA, "deposit_balance"), (_DA, "deposit_interest_term")) else ""
    _add(f"edge_{_a}_{_b}", f"SELECT t.{_dim} AS {_b}_{_dim}, {_OWN[_a][1]} AS {_a}_{_OWN[_a][0]} FROM {_a} o LEFT JOIN {_b} t ON o.{_key} = t.{_their}{_live} GROUP BY 1", _a, _b)

_add("rel_aml", "SELECT aml_risk_rating, kyc_status, count(*) AS customer_count FROM party_role_customer WHERE md_is_active GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", _PC)
_add("rel_default", "SELECT party_type, count(*) AS party_count FROM party WHERE md_is_active GROUP BY 1", "party")
_add("rel_five_way_active", f"SELECT p.party_type, c.customer_segment, u.currency_name, count(*) AS n_accounts, {_sum('b.available_balance')} AS available_balance FROM party p JOIN party_role_customer c USING (party_id) JOIN deposit_account a ON a.customer_id = c.party_role_customer_id JOIN deposit_balance b USING (deposit_account_id) JOIN ref_currency u ON u.currency_code = a.currency_code WHERE p.md_is_active AND c.md_is_active AND a.md_is_active AND b.md_is_active GROUP BY 1, 2, 3", "party", _PC, _DA, "deposit_balance", "ref_currency")

_HISTORY = """h AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from,
         coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), TIMESTAMP '9999-12-31 23:59:59') AS valid_to,
         lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) IS NULL AS is_active
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1)"""
_add("scd2_versions", f"WITH {_HISTORY} SELECT * FROM h")
_add("scd2_active", f"WITH {_HISTORY} SELECT o_orderstatus, count(*) AS n_active FROM h WHERE is_active GROUP BY 1")
_add("scd2_as_of", f"WITH {_HISTORY} SELECT o_custkey, o_orderkey, o_orderstatus FROM h WHERE valid_from <= TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' < valid_to")
_add("scd2_overlap_violations", "SELECT b.o_custkey, count(*) AS n_overlaps FROM orders b WHERE EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = b.o_custkey AND (a.o_orderdate, a.o_orderkey) < (b.o_orderdate, b.o_orderkey) AND a.o_orderdate + INTERVAL 30 DAY > b.o_orderdate) GROUP BY 1")
_add("scd2_apply_several", f"WITH {_HISTORY} SELECT o_custkey, o_orderkey, o_orderstatus, valid_from, CASE WHEN is_active AND o_custkey % 7 = 0 THEN TIMESTAMP '2005-01-01' ELSE valid_to END AS valid_to, is_active AND o_custkey % 7 <> 0 AS is_active FROM h UNION ALL SELECT o_custkey, o_orderkey, 'X', TIMESTAMP '2005-01-01', TIMESTAMP '2006-01-01', FALSE FROM h WHERE is_active AND o_custkey % 7 = 0 UNION ALL SELECT o_custkey, o_orderkey, 'Y', TIMESTAMP '2006-01-01', TIMESTAMP '9999-12-31 23:59:59', TRUE FROM h WHERE is_active AND o_custkey % 7 = 0")
_add("scd2_as_of_join", f"WITH {_HISTORY} SELECT o.o_orderkey, h.o_orderkey AS v_version, h.o_orderstatus AS v_o_orderstatus FROM orders o LEFT JOIN h ON h.o_custkey = o.o_custkey AND h.valid_from <= o.o_orderdate - INTERVAL 10 DAY AND o.o_orderdate - INTERVAL 10 DAY < h.valid_to")
_add("scd2_integrity", f"WITH {_HISTORY} SELECT 'disordered' AS rule, count(*) AS n FROM h WHERE valid_from >= valid_to UNION ALL SELECT 'several_active', count(*) FROM (SELECT o_custkey FROM h WHERE is_active GROUP BY 1 HAVING count(*) > 1)")
_add("scd2_apply_change", f"WITH {_HISTORY} SELECT o_custkey, o_orderkey, o_orderstatus, valid_from, CASE WHEN is_active AND o_custkey % 7 = 0 THEN TIMESTAMP '2005-01-01' ELSE valid_to END AS valid_to, is_active AND o_custkey % 7 <> 0 AS is_active FROM h UNION ALL SELECT o_custkey, o_orderkey, 'X', TIMESTAMP '2005-01-01', TIMESTAMP '9999-12-31 23:59:59', TRUE FROM h WHERE is_active AND o_custkey % 7 = 0")

_add("graph_loan_collateral_top5", "SELECT l.loan_agreement_id, k.collateral_type, CAST(k.estimated_value AS DOUBLE) AS estimated_value, l_partkey, l_suppkey FROM loan_agreement l JOIN loan_collateral k USING (loan_agreement_id) WHERE l.md_is_active AND k.md_is_active ORDER BY 3 DESC, 1, 4, 5 LIMIT 5", _LA, _LC)
_add("graph_customer_account_balance", "SELECT c.customer_number, a.account_type, CAST(b.available_balance AS DOUBLE) AS available_balance FROM party_role_customer c JOIN deposit_account a ON a.customer_id = c.party_role_customer_id JOIN deposit_balance b USING (deposit_account_id) WHERE c.md_is_active AND a.md_is_active AND b.md_is_active ORDER BY 3, 1 LIMIT 5", _PC, _DA, "deposit_balance")
_add("graph_individual_customers", "SELECT i.first_name || ' ' || i.last_name AS full_name, c.customer_number, c.aml_risk_rating FROM party_individual i JOIN party_role_customer c USING (party_id) WHERE i.md_is_active AND c.md_is_active AND c.aml_risk_rating = 'HIGH' ORDER BY 2 LIMIT 5", "party_individual", _PC)
_add("graph_party_overview", "SELECT party_type, count(*) AS n_parties FROM party WHERE md_is_active GROUP BY 1", "party")
_NODES = (("Party", "party"), ("Individual", "party_individual"), ("Organization", "party_organization"), ("Customer", _PC), ("DepositAccount", _DA), ("DepositBalance", "deposit_balance"), ("LoanApplication", _LP), ("LoanAgreement", _LA), ("LoanCollateral", _LC), ("RefCountry", "ref_country"), ("RefCurrency", "ref_currency"), ("RefIndustry", "ref_nace_industry"))
_INVENTORY = " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n_nodes FROM {t}" + ("" if t.startswith("ref_") else " WHERE md_is_active") for n, t in _NODES)
_add("graph_label_inventory", _INVENTORY, *[t for _, t in _NODES])
_add("graph_untyped_nodes", f"SELECT * FROM ({_INVENTORY}) WHERE label NOT IN ({', '.join(_text(c[0]) for c in CLASSES)})", *[t for _, t in _NODES])
_EDGE = "SELECT '{k}' AS edge_type, count(*) AS n FROM {a} a JOIN {b} b ON {on} WHERE {w}"
_EDGES = (
    ("CITIZEN_OF", "party_individual", "ref_country", "a.citizenship_country_code = b.country_code", "a.md_is_active"), ("OPERATES_IN_INDUSTRY", "party_organization", "ref_nace_industry", "a.nace_code = b.nace_code", "a.md_is_active"),
    ("PLAYS_ROLE", "party", _PC, "a.party_id = b.party_id", "a.md_is_active AND b.md_is_active"), ("HOLDS_ACCOUNT", _PC, _DA, "b.customer_id = a.party_role_customer_id", "a.md_is_active AND b.md_is_active"), ("DENOMINATED_IN", _DA, "ref_currency", "a.currency_code = b.currency_code", "a.md_is_active"),
    ("HAS_BALANCE", _DA, "deposit_balance", "a.deposit_account_id = b.deposit_account_id", "a.md_is_active AND b.md_is_active"), ("APPLIED_FOR", _PC, _LP, "b.customer_id = a.party_role_customer_id", "a.md_is_active AND b.md_is_active"), ("BORROWER_OF", _PC, _LA, "b.customer_id = a.party_role_customer_id", "a.md_is_active AND b.md_is_active"),
    ("DENOMINATED_IN", _LA, "ref_currency", "a.currency_code = b.currency_code", "a.md_is_active"), ("ORIGINATED", _LP, _LA, "a.loan_application_id = b.loan_application_id", "a.md_is_active AND b.md_is_active"), ("SECURED_BY", _LA, _LC, "a.loan_agreement_id = b.loan_agreement_id", "a.md_is_active AND b.md_is_active"),
)
_add("graph_edge_inventory", "SELECT edge_type, CAST(sum(n) AS BIGINT) AS n_edges FROM (" + " UNION ALL ".join(_EDGE.format(k=k, a=a, b=b, on=on, w=w) for k, a, b, on, w in _EDGES) + ") GROUP BY 1", *[t for _, t in _NODES])
_add("graph_most_edges", "WITH per AS (SELECT customer_id AS src, count(*) AS n FROM loan_agreement l JOIN party_role_customer c ON c.party_role_customer_id = l.customer_id WHERE l.md_is_active AND c.md_is_active GROUP BY 1) SELECT (SELECT max(n) FROM per) AS max_loans, (SELECT count(*) FROM party_role_customer WHERE md_is_active AND party_role_customer_id NOT IN (SELECT src FROM per)) AS n_without", _LA, _PC)
_add("graph_most_specific_type", "SELECT CASE party_type WHEN 'ORGANIZATION' THEN 'Organization' ELSE 'Individual' END AS class, count(*) AS n_nodes FROM party WHERE md_is_active GROUP BY 1", "party")

_EDGE_SUM = "SELECT CAST(sum(n) AS BIGINT) FROM (" + " UNION ALL ".join(_EDGE.format(k=k, a=a, b=b, on=on, w=w) for k, a, b, on, w in _EDGES) + ")"
_add("graph_totals", f"SELECT (SELECT CAST(sum(n_nodes) AS BIGINT) FROM ({_INVENTORY})) AS n_nodes, ({_EDGE_SUM}) AS n_edges", *[t for _, t in _NODES])
_add("graph_degrees", "SELECT n, count(*) AS n_customers FROM (SELECT c.party_role_customer_id, count(l.loan_agreement_id) AS n FROM party_role_customer c LEFT JOIN loan_agreement l ON l.customer_id = c.party_role_customer_id AND l.md_is_active WHERE c.md_is_active GROUP BY 1) GROUP BY 1", _LA, _PC)
_add("graph_labelled", "SELECT party_id AS node_id FROM party WHERE md_is_active AND party_type = 'ORGANIZATION'", "party")
_KEYS_OF = {"RefCountry": "country_code", "RefCurrency": "currency_code", "RefIndustry": "nace_code"}
_add("graph_untyped_ids", " UNION ALL ".join(f"SELECT '{n}' AS label, CAST({_KEYS_OF[n]} AS VARCHAR) AS node_id FROM {t}" for n, t in _NODES if n in _KEYS_OF), *[t for n, t in _NODES if n in _KEYS_OF])
_add("graph_full_text", """WITH n AS (SELECT 'Individual' AS label, party_id AS node_id, first_name || ' ' || last_name AS name FROM party_individual WHERE md_is_active UNION ALL SELECT 'Organization', party_id, legal_name FROM party_organization WHERE md_is_active UNION ALL SELECT 'Customer', party_role_customer_id, customer_number FROM party_role_customer WHERE md_is_active)
SELECT label, node_id, name, score FROM (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')), ['customer', '000000001', 'first'])) + CAST(lower(name) = 'customer#000000001 first' AS BIGINT) AS score FROM n) WHERE score > 0 ORDER BY score DESC, label, node_id LIMIT 10""", "party_individual", "party_organization", _PC)

_CLASS = _values([(n, label, c) for n, label, c, _, _ in CLASSES], "concept", "label", "definition")
_SUB = _values([(n, p) for n, _, _, p, _ in CLASSES if p], "child", "parent")
_BRIDGE = _values([(f"{schema_of(t)}.{t}", t, e) for t, e in ENTITIES.items()], "table_name", "cube", "entity")
_REACH = f"reach(ancestor, descendant, depth) AS (SELECT parent, child, 1 FROM {_SUB} UNION ALL SELECT e.parent, r.descendant, r.depth + 1 FROM reach r JOIN {_SUB} e ON e.child = r.ancestor)"
_add("onto_closure", f"WITH RECURSIVE {_REACH} SELECT ancestor, descendant, min(depth) AS depth FROM reach GROUP BY 1, 2")
_GROUND = _values([(n, g) for n, _, _, _, gs in CLASSES for g in gs], "concept", "external")
_add("onto_describe", f"WITH RECURSIVE {_REACH} SELECT c.concept, coalesce(n, 0) AS n_subclasses, coalesce(s, '') AS subclasses, coalesce(g, '') AS grounded_in, table_name AS source_table, cube AS semantic_cube FROM {_CLASS} c LEFT JOIN (SELECT ancestor, count(*) AS n, string_agg(descendant, ',' ORDER BY descendant) AS s FROM reach GROUP BY 1) ON ancestor = c.concept LEFT JOIN (SELECT concept, string_agg(external, ',' ORDER BY external) AS g FROM {_GROUND} GROUP BY 1) x ON x.concept = c.concept LEFT JOIN {_BRIDGE} b ON b.entity = c.concept")
_add("onto_search", f"SELECT concept, label, definition FROM {_CLASS} WHERE contains(lower(concept), 'loan') OR contains(lower(label), 'loan') OR contains(lower(definition), 'loan')")
_SINGULAR = "CASE WHEN length(x) > 3 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 3 AND x LIKE '%ses' THEN left(x, length(x) - 2) WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END"
_TOKENS = "list_distinct(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: " + _SINGULAR + "))"
_STOP = "[" + ", ".join(map(_text, LABEL_STOP_WORDS)) + "]"
_PROMPTS = _values(PROMPTS, "prompt_id", "prompt")
_MATCH = f"""m AS (
  SELECT prompt_id, concept, CASE WHEN list_has_all(w, name) THEN 'name' WHEN len(lab) > 0 AND list_has_all(w, lab) THEN 'label' END AS match_reason
  FROM (SELECT prompt_id, {_TOKENS.format(c="prompt")} AS w FROM {_PROMPTS}),
       (SELECT concept, {_TOKENS.format(c="regexp_replace(concept, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')")} AS name, list_filter({_TOKENS.format(c="label")}, lambda y: NOT list_contains({_STOP}, y)) AS lab FROM {_CLASS}))"""
_add("onto_match_prompts", f"WITH {_MATCH} SELECT * FROM m WHERE match_reason IS NOT NULL")
_EXPAND = f"""{_REACH}, {_MATCH}, pulled AS (
  SELECT prompt_id, concept, match_reason AS reason, 0 AS depth FROM m WHERE match_reason IS NOT NULL
  UNION ALL SELECT prompt_id, descendant, 'subclass of ' || concept, depth FROM m JOIN reach ON ancestor = concept WHERE match_reason IS NOT NULL),
first AS (SELECT prompt_id, concept, reason FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, concept ORDER BY depth, reason) AS n FROM pulled) WHERE n = 1)"""
_add("onto_expand_tables", f"WITH RECURSIVE {_EXPAND} SELECT prompt_id, concept, reason, table_name AS source_table FROM first LEFT JOIN {_BRIDGE} b ON b.entity = concept")
_COUNTS = " UNION ALL ".join(f"SELECT 'financial.{t}' AS source_table, count(*) AS row_count FROM {t}" + (" WHERE md_is_active" if "md_is_active" in LOGICAL[t] else "") for t in ENTITIES if schema_of(t) == "financial")
_add("onto_grounded_counts", f"WITH RECURSIVE {_EXPAND} SELECT * FROM ({_COUNTS}) WHERE source_table IN (SELECT table_name FROM first JOIN {_BRIDGE} b ON b.entity = concept)", *[t for t in ENTITIES if schema_of(t) == "financial"])
_BARE = {c.name: len(c.dimensions) + sum(m.sql[1:].isidentifier() and m.sql[:1] == "$" for m in c.measures.values()) for c in CUBES.values()}
_add("lineage_columns", f"SELECT cube, n_columns FROM {_values(_BARE.items(), 'cube', 'n_columns')}")
_add("lineage_three_hop", f"SELECT entity, table_name, cube, label FROM {_BRIDGE} LEFT JOIN {_CLASS} ON concept = entity")

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"{_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')}))"
_NEAR = f"near AS (SELECT query_id, id, round(s, 4) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)) WHERE rank <= 10)"


def _bm25(docs: str, queries: str, k: int) -> str:
    """Common tables that end in bm25 (query_id, rank, id, score): every document of docs (id, text) scored for every query of queries (query_id, text)."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"
    return f"""bm_docs AS MATERIALIZED (SELECT id, {words} AS w FROM ({docs})),
bm_stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM bm_docs),
bm_tf AS MATERIALIZED (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM bm_docs) GROUP BY ALL),
bm_idf AS (SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM bm_tf GROUP BY term), bm_stats),
bm_asked AS (SELECT DISTINCT query_id, unnest({words}) AS term FROM ({queries})),
bm_scores AS (
  SELECT query_id, id, CAST(sum(CAST(round(idf * (tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS DECIMAL(18,9))) AS DOUBLE) AS score
  FROM bm_asked JOIN bm_idf USING (term) JOIN bm_tf USING (term), bm_stats GROUP BY query_id, id),
bm25 AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM bm_scores) WHERE rank <= {k})"""


_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_add("search_bm25", f"WITH {_bm25('SELECT doc_id AS id, text FROM documents', _ITEMS, 10)} SELECT * FROM bm25")
_OVERLAP_Q, _OVERLAP_D = ("list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+'))", "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')")
_add("search_reranked", f"""WITH {_bm25('SELECT doc_id AS id, text FROM documents', _ITEMS, 20)},
pairs AS (SELECT query_id, id, {_OVERLAP_Q} AS q, {_OVERLAP_D} AS d FROM bm25 JOIN (SELECT doc_id AS id, text FROM documents) USING (id) JOIN (SELECT item_id AS query_id, text AS query FROM benchmark) USING (query_id)),
scored AS (SELECT query_id, id, CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0.0::DOUBLE ELSE round(len(list_filter(d, lambda w: list_contains(q, w)))::DOUBLE / sqrt(len(q)::DOUBLE * len(d)), 4) END AS cross_score FROM pairs)
SELECT query_id, id, cross_score, rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, id) AS rerank FROM scored) WHERE rerank <= 3""")
_add("search_fused", f"""WITH {_bm25('SELECT doc_id AS id, text FROM documents', _ITEMS, 20)},
near AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS s FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 20),
parts AS (SELECT query_id, id, rank FROM bm25 UNION ALL SELECT query_id, id, rank FROM near),
fused AS (SELECT query_id, id, CAST(sum(CAST(round(1::DOUBLE / (60::DOUBLE + rank), 9) AS DECIMAL(18,9))) AS DOUBLE) AS score FROM parts GROUP BY query_id, id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM fused) WHERE rank <= 10""")
_add("graph_name_search", f"""WITH {_bm25("SELECT 'Individual:' || CAST(party_id AS VARCHAR) AS id, first_name || ' ' || last_name AS text FROM party_individual WHERE md_is_active UNION ALL SELECT 'Organization:' || CAST(party_id AS VARCHAR), legal_name FROM party_organization WHERE md_is_active UNION ALL SELECT 'Customer:' || CAST(party_role_customer_id AS VARCHAR), customer_number FROM party_role_customer WHERE md_is_active", "SELECT * FROM (VALUES (1, 'Customer#000000012'), (2, 'First customer 000000007 trading')) q(query_id, text)", 5)} SELECT * FROM bm25""", "party_individual", "party_organization", "party_role_customer")
_add("vec_knn_cosine", f"WITH {_NEAR} SELECT * FROM near")
_add("vec_two_stage_rerank", f"WITH {_NEAR} SELECT query_id, id, cross_score, rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, id) AS rerank FROM (SELECT query_id, id, round((CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + similarity, 4) AS cross_score FROM near JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = query_id)) WHERE rerank <= 3")
_add("vec_degraded_embed", """WITH w AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark),
g AS (SELECT id, substr(word, i, 3) AS piece FROM (SELECT id, word, unnest(range(1, length(word) + 1)) AS i FROM w)),
c AS (SELECT id, CAST(('0x' || substr(md5(piece), 1, 8)) AS BIGINT) % 384 AS bucket, count(*) AS n FROM g GROUP BY 1, 2)
SELECT id, bucket, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY id) AS DOUBLE)), 6) AS weight FROM c""")
_add("vec_upsert", "WITH n AS (SELECT CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE -vec_id END AS vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0) SELECT coalesce(e.vec_id, n.vec_id) AS vec_id, coalesce(n.label, e.label) AS label, CASE WHEN e.vec_id IS NULL THEN 0.0::DOUBLE ELSE CAST(e.embedding[1] AS DOUBLE) END AS first FROM embeddings e FULL JOIN n ON e.vec_id = n.vec_id")
_QUERY = _values(((1, "the thing that was and the other"), (2, "de la que en"), (3, "nothing zzz")), "query_id", "query")
_add("lex_overlap_score", f"""WITH p AS (SELECT query_id, item_id AS id, list_distinct(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS q, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS d FROM benchmark, {_QUERY}),
s AS (SELECT query_id, id, CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0.0 ELSE round(CAST(len(list_filter(d, lambda x: list_contains(q, x))) AS DOUBLE) / sqrt(CAST(len(q) AS DOUBLE) * len(d)), 4) END AS cross_score FROM p)
SELECT query_id, id, cross_score, rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cross_score DESC, id) AS rerank FROM s) WHERE rerank <= 3""")

_CUBES = _values([(c.name, cube_text(c)) for c in CUBES.values()], "id", "content")
_GRAMS = """SELECT id, CAST(('0x' || substr(md5(substr(word, i, 3)), 1, 8)) AS BIGINT) % 384 AS bucket, count(*) AS n FROM (SELECT id, word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT {i} AS id, unnest(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM {t})) GROUP BY 1, 2"""
_UNI = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
_add("vec_prompt_search", f"""WITH docs AS (SELECT * FROM {_CUBES}), prompts AS (SELECT * FROM {_PROMPTS}), d AS ({_GRAMS.format(i="id", c="content", t="docs")}), q AS ({_GRAMS.format(i="prompt_id", c="prompt", t="prompts")}),
s AS (SELECT q.id AS prompt_id, d.id AS fqn, CAST(sum(d.n * q.n) AS DOUBLE) / (any_value(a) * any_value(b)) AS s FROM d JOIN q USING (bucket) JOIN (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS a FROM d GROUP BY 1) x ON x.id = d.id JOIN (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS b FROM q GROUP BY 1) y ON y.id = q.id GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY s DESC, fqn) AS r FROM s),
c AS (SELECT prompt_id, fqn, round(s, 4) AS similarity, list_distinct({_UNI.format(c="prompt")}) AS w, {_UNI.format(c="content")} AS v FROM n JOIN docs ON docs.id = fqn JOIN prompts USING (prompt_id) WHERE r <= 10),
x AS (SELECT prompt_id, fqn, similarity, CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0.0 ELSE round(CAST(len(list_filter(v, lambda z: list_contains(w, z))) AS DOUBLE) / sqrt(CAST(len(w) AS DOUBLE) * len(v)), 4) END AS cross_score FROM c)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY cross_score DESC, fqn) AS rank FROM x) WHERE rank <= 3""")

# The catalog, from what DuckDB says of the projections.
_IN = lambda t: "ref" if t.startswith("ref_") else "financial"
_SCHEMA = "(" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{_IN(t)}' AS schema_name, column_name FROM (DESCRIBE {q})" for t, q in LOGICAL.items()) + ")"
_CLASS_OF = "CASE WHEN " + " OR ".join(f"contains(column_name, '{w}')" for w in ("id_number", "date_of_birth", "registration_number", "gender", "party_bk")) + " THEN 'PersonalData.SpecialCategory' WHEN " + " OR ".join(f"contains(column_name, '{w}')" for w in ("first_name", "last_name", "street_address", "building_number", "city", "postal_code", "account_number")) + " THEN 'PersonalData.Personal' END"
_GROUNDED = _values(GROUNDINGS.items(), "t", "g")
_add("catalog_entities", f"SELECT schema_name || '.' || table_name AS fqn, table_name AS name, n_columns, CASE WHEN tags IS NULL THEN 'Grounding.' || g ELSE tags || ',Grounding.' || g END AS tags FROM (SELECT schema_name, table_name, count(*) AS n_columns, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT *, {_CLASS_OF} AS tag FROM {_SCHEMA}) GROUP BY 1, 2) JOIN {_GROUNDED} ON t = table_name")
_add("catalog_columns", f"SELECT schema_name, table_name, column_name, CASE WHEN table_name = 'party' AND column_name = 'party_bk' THEN 'Business key' END AS comment FROM {_SCHEMA}")
_add("catalog_upsert", f"SELECT schema_name || '.' || table_name AS fqn, table_name AS name, CASE WHEN table_name = 'party' THEN 0 ELSE count(*) END AS n_columns FROM {_SCHEMA} GROUP BY schema_name, table_name UNION ALL SELECT 'financial.extra', 'extra', 1")
_add("top_catalog_hits", f"SELECT table_name, schema_name || '.' || table_name AS fqn, score FROM (SELECT table_name, schema_name, count(DISTINCT w) AS score FROM (SELECT table_name, schema_name, unnest(regexp_extract_all(replace(lower(table_name || ' ' || column_name), '_', ' '), '[a-z0-9]+')) AS w FROM {_SCHEMA}) WHERE w IN ('loan', 'collateral', 'value', 'status') GROUP BY 1, 2) ORDER BY score DESC, table_name LIMIT 5")
_add("catalog_constraints", "SELECT * FROM (VALUES ('PRIMARY KEY', 19), ('FOREIGN KEY', 21), ('CHECK', 22)) t(kind, n)")
_PROFILED = (("party", ("party_id", "party_bk", "party_type")), ("loan_repayment_schedule", ("loan_agreement_id", "installment_number", "installment_status")))
_add("catalog_profiles", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cs in _PROFILED for c in cs), "party", "loan_repayment_schedule")


def _suite(t: str, source: str, bounds, filled, unique, allowed: dict) -> list[str]:
    tests = [("row_count_between", "", f"CASE WHEN count(*) BETWEEN {bounds[0]} AND {bounds[1]} THEN 0 ELSE 1 END")] if bounds else []
    tests += [("not_null", c, f"count(*) - count({c})") for c in filled] + [("unique", c, f"count({c}) - count(DISTINCT {c})") for c in unique]
    tests += [("allowed_values", c, f"count(*) FILTER (WHERE {c} NOT IN ({', '.join(map(_text, v))}))") for c, v in allowed.items()]
    return [f"SELECT '{t}' AS table_name, '{a}' AS assertion, '{c}' AS column_name, CAST({e} AS BIGINT) AS n_failing, {e} = 0 AS passed FROM {source}" for a, c, e in tests]


_flagged = lambda t: f"(SELECT * FROM {t}" + (" WHERE md_is_active)" if "md_is_active" in LOGICAL[t] else ")")
_add("dq_suites", " UNION ALL ".join(x for t, (bounds, filled, unique) in SUITES.items() for x in _suite(t, _flagged(t), bounds, filled, unique, ALLOWED.get(t, {}))), *SUITES)
_REPAYMENTS = " UNION ALL ".join(_suite("loan_repayment_schedule", _flagged("loan_repayment_schedule"), *SUITES["loan_repayment_schedule"], ALLOWED["loan_repayment_schedule"]))
_add("dq_check_table", f"SELECT table_name || '_' || assertion || CASE WHEN column_name <> '' THEN '_' || column_name ELSE '' END AS test_name, CASE WHEN passed THEN 'Success' ELSE 'Failed' END AS status, CAST(n_failing AS VARCHAR) || ' failing' AS result_message FROM ({_REPAYMENTS})", "loan_repayment_schedule")
_RULES = (("party", (11, 1 << 62), ("party_id", "party_bk", "party_type", "status_code"), ("party_id",), {"party_type": ("INDIVIDUAL", "ORGANIZATION"), "status_code": ("ACTIVE", "INACTIVE", "SUSPENDED")}), (_DA, (1_000_000_001, 1 << 62), ("deposit_account_id", "account_number", "account_type", "account_status"), ("deposit_account_id",), {"account_type": ("SAVINGS", "CHECKING"), "account_status": ("ACTIVE", "DORMANT", "FROZEN", "CLOSED")}), (_LA, None, ("loan_agreement_id", "agreement_status"), ("loan_agreement_id",), {"agreement_status": ("ACTIVE", "DEFAULTED", "PAID_OFF", "FROZEN")}))
_add("contract_rules", " UNION ALL ".join(x for t, *rest in _RULES for x in _suite(t, t, *rest)), *[r[0] for r in _RULES])
_add("contract_find_drift", "SELECT * FROM (VALUES ('loan_guarantee', NULL, 'unqualified_model', NULL), ('financial.loan_guarantor', NULL, 'missing_table', NULL), ('financial.deposit_account', 'overdraft_code', 'phantom_column', NULL), ('financial.loan_agreement', 'agreement_status', 'unwritable_value', 'FROZEN'), ('financial.deposit_account', 'account_type', 'missing_value', 'TERM_DEPOSIT')) t(model, column_name, problem, detail)")
_add("contract_products", "SELECT * FROM (VALUES ('Party Data Product', 'Party', '1.0', 'active', 1), ('Deposit Data Product', 'Deposits', '1.1', 'active', 1), ('Loan Data Product', 'Loans', '0.9', 'draft', 3)) t(product, domain, version, status, n_models)")
_add("contract_freshness", "SELECT 'events' AS table_name, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts))) AS BIGINT) AS age_seconds, coalesce(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts))) <= 3600, FALSE) AS fresh FROM events")

_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_add("dq_profile", "WITH g AS (SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM customer) " + " UNION ALL ".join(f"SELECT 'customer' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM g" for c in _COLUMNS))


def _tests() -> str:
    rows = []
    spec = (
        ("customer", (1, 10**12), ("c_custkey", "c_name"), ("c_custkey", "c_name"), {"c_mktsegment": ("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD")}), ("orders", (1, 10**12), ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderkey",), {"o_orderstatus": ("O", "F")}),
        ("lineitem", (1, 10**12), ("l_orderkey", "l_partkey"), ("l_orderkey",), {"l_returnflag": ("A", "N", "R")}), ("part", (1, 100), ("p_partkey",), ("p_partkey", "p_name"), {}),
    )
    for t, (low, high), filled, unique, allowed in spec:
        tests = [("row_count_between", "", f"CASE WHEN count(*) BETWEEN {low} AND {high} THEN 0 ELSE 1 END")] + [("not_null", c, f"count(*) - count({c})") for c in filled] + [("unique", c, f"count({c}) - count(DISTINCT {c})") for c in unique]
        tests += [("allowed_values", c, f"count(*) FILTER (WHERE {c} NOT IN ({', '.join(map(_text, v))}))") for c, v in allowed.items()]
        rows += [f"SELECT '{t}' AS table_name, '{a}' AS assertion, '{c}' AS column_name, CAST({e} AS BIGINT) AS n_failing, {e} = 0 AS passed FROM {t}" for a, c, e in tests]
    return " UNION ALL ".join(rows)


_add("dq_assertions", _tests())
_add("dq_summary", f"SELECT passed, count(*) AS n_assertions FROM ({_tests()}) GROUP BY 1")
_add("dq_referential", "SELECT 'lineitem_orders' AS relationship, count(*) AS n_orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders_active_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)")
_ACTUAL = _values([("customer", c) for c in _COLUMNS] + [("region", "r_regionkey"), ("region", "r_name")], "table_name", "column_name")
_DECL = _values(DECLARED, "table_name", "column_name")
_add("contract_drift", f"SELECT table_name, NULL::VARCHAR AS column_name, 'missing_table' AS problem FROM {_DECL} WHERE table_name NOT IN (SELECT table_name FROM {_ACTUAL}) UNION ALL SELECT table_name, column_name, 'phantom_column' FROM {_DECL} WHERE table_name IN (SELECT table_name FROM {_ACTUAL}) AND (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM {_ACTUAL}) UNION ALL SELECT table_name, column_name, 'undeclared_column' FROM {_ACTUAL} WHERE (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM {_DECL})")

_TAGS = (("first_name", "Personal"), ("home_city", "Personal"), ("id_number_hash", "SpecialCategory"), ("gender", "SpecialCategory"), ("party_bk", "SpecialCategory"), ("balance", None), ("account_number", "Personal"), ("date_of_birth", "SpecialCategory"), ("registration_number", "SpecialCategory"), ("postal_code_2", "Personal"), ("amount", None))
_add("pii_column_tags", f"SELECT * FROM {_values(_TAGS, 'column_name', 'pii_class')}")
_SPECIAL, _PERSONAL = "'[REDACTED - PersonalData.SpecialCategory]'", "'[REDACTED - PersonalData.Personal]'"
_hidden = lambda c, m: f"CASE WHEN {c} IS NOT NULL THEN {m} END"
_add("pii_mask_rows", f"SELECT * REPLACE ({_hidden('first_name', _PERSONAL)} AS first_name, {_hidden('last_name', _PERSONAL)} AS last_name, {_hidden('gender', _SPECIAL)} AS gender, {_hidden('date_of_birth', _SPECIAL)} AS date_of_birth) FROM party_individual", "party_individual")
_add("pii_mask_nested", f"SELECT party_id, {_hidden('first_name', _PERSONAL)} AS a, md_is_active AS b, {_hidden('gender', _SPECIAL)} AS c, {_hidden('last_name', _PERSONAL)} AS d, {_hidden('gender', _SPECIAL)} AS e, 'k' AS f FROM party_individual", "party_individual")
_add("sql_guarded_masked", "SELECT party_id, CASE WHEN last_name IS NOT NULL THEN '[REDACTED]' END AS nick, CASE WHEN gender IS NOT NULL THEN '[REDACTED]' END AS g FROM party_individual ORDER BY party_id LIMIT 200", "party_individual")
_add("sql_guarded_union", "SELECT party_id, '[REDACTED]' AS shown, kyc_status AS state FROM party_role_customer UNION ALL SELECT party_id, '[REDACTED]', 'person' FROM party_individual", "party_role_customer", "party_individual")
_add("sql_guarded_explode", "WITH a AS (SELECT party_id, citizenship_country_code AS country, CASE WHEN i = 1 OR gender IS NOT NULL THEN '[REDACTED]' END AS item FROM party_individual, (VALUES (1), (2)) t(i)) SELECT a.party_id, a.country, a.item, b.item AS other, '[REDACTED]' AS top FROM a JOIN a b USING (party_id)", "party_individual")
_add("sql_guarded_uncapped", "SELECT party_type, party_id FROM party WHERE md_is_active", "party")
_SAMPLE = _values(SAMPLES, "doc_id", "text")
_TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {_SAMPLE})"


def _redacted(column: str) -> str:
    for kind, pattern in PII_PATTERNS:
        column = f"regexp_replace({column}, {_text(pattern)}, {_text(chr(92) + '1' if kind in LABELLED else '')} || '[REDACTED_{kind}]', 'g')"
    return column


_add("pii_redact_text", f"SELECT doc_id, turn, md5({_redacted('text')}) AS digest FROM (SELECT doc_id, 0 AS turn, text FROM {_SAMPLE} UNION ALL SELECT conv_id, turn, text FROM conversations)")
_add("pii_counts", "SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, {_text(dict(PII_PATTERNS)[k])}))) AS BIGINT) AS n_{k.lower()}" for k in ("EMAIL", "SSN", "CREDIT_CARD", "IBAN")) + f" FROM {_TEXTS}")
_HITS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_text('(?i)' + p)}) THEN {i} END" for i, p in enumerate(INJECTION_PATTERNS)) + "], lambda x: x IS NOT NULL)"
_add("inj_scan", f"SELECT doc_id, len(h) AS n_patterns, CAST(h[1] AS BIGINT) AS first_pattern FROM (SELECT doc_id, {_HITS} AS h FROM {_TEXTS})")
_CLEAN = "text"
for _p in INJECTION_PATTERNS:
    _CLEAN = f"regexp_replace({_CLEAN}, {_text('(?i)' + _p)}, '[QUARANTINED]', 'g')"
_add("inj_quarantine", f"SELECT doc_id, md5({_CLEAN}) AS digest FROM {_TEXTS}")
_MARKS = "len(regexp_extract_all({c}, '\\[REDACTED_'))"
_add("gov_sanitised", f"WITH r AS (SELECT doc_id, turn, text AS raw, {_redacted('text')} AS text FROM (SELECT doc_id, 0 AS turn, text FROM {_SAMPLE} UNION ALL SELECT conv_id, turn, text FROM conversations)), h AS (SELECT *, len({_HITS}) AS n_patterns FROM r) SELECT doc_id, turn, md5({_CLEAN}) AS digest, {_MARKS.format(c='text')} - {_MARKS.format(c='raw')} AS pii_redactions_applied, n_patterns, CASE WHEN n_patterns > 0 THEN 'REVIEW_REQUIRED' ELSE 'SECURE' END AS safety_status, n_patterns > 0 AS content_quarantined FROM h")
_BODY = """regexp_replace(trim(regexp_replace(regexp_replace(statement, '''(?:[^'']|'''')*''', '''''', 'g'), '"[^"]*"', '""', 'g')), ';\\s*$', '')"""
_add("guard_readonly", f"SELECT id, NOT contains(b, ';') AND regexp_matches(b, '(?i)^\\s*(?:SELECT|WITH|EXPLAIN)\\b') AND NOT regexp_matches(b, '(?i)\\b(?:{'|'.join(FORBIDDEN_SQL)})\\b') AS allowed FROM (SELECT id, {_BODY} AS b FROM {_values(STATEMENTS, 'id', 'statement')})")

_HAS = lambda words: " OR ".join(f"contains(lower(prompt), '{w}')" for w in words)
_add("intent_classify", f"SELECT prompt_id, CASE WHEN {_HAS(('collateral', 'pledged', 'real estate', 'asset'))} THEN 'collateral' WHEN {_HAS(('overdrawn', 'overdraft', 'deposit', 'balance', 'facility'))} THEN 'deposit' WHEN {_HAS(('aml', 'risk', 'individual', 'party', 'kyc'))} THEN 'aml_risk' ELSE 'default' END AS intent FROM {_PROMPTS}")
_TURNS = "t AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_KEYS = "list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]{{3,}}'))"
_FACTS = "list_distinct(regexp_extract_all(coalesce({c}, ''), '\\b(?:\\d+(?:\\.\\d+)?|[A-Z_]{{3,}})\\b'))"
_COVER = "CASE WHEN length(trim(coalesce(response, ''))) = 0 THEN 0.0::DOUBLE WHEN len(p) = 0 THEN 1.0::DOUBLE WHEN len({c}) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(p, {c}))::DOUBLE / len(p), 4) END"
_TRIAD = f"""{_TURNS}, g AS (SELECT t.*, b.text AS context FROM t LEFT JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1),
k AS (SELECT *, {_KEYS.format(c="prompt")} AS p, {_KEYS.format(c="response")} AS r, {_KEYS.format(c="context")} AS x, {_FACTS.format(c="context")} AS kf, {_FACTS.format(c="response")} AS rf FROM g),
s AS (SELECT conv_id, turn, {_COVER.format(c="x")} AS context_relevance, {_COVER.format(c="r")} AS answer_relevance,
        CASE WHEN length(trim(coalesce(response, ''))) = 0 THEN 0.0::DOUBLE WHEN len(rf) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(rf, lambda f: list_contains(kf, f) OR contains(lower(coalesce(context, '')), lower(f))))::DOUBLE / len(rf), 4) END AS faithfulness FROM k),
triad AS (SELECT *, round((context_relevance + faithfulness + answer_relevance) / 3, 4) AS composite FROM s)"""
_add("triad_scores", f"WITH {_TRIAD} SELECT * FROM triad")
_add("triad_evaluation", f"WITH {_TRIAD}, e AS (SELECT conv_id % 3 AS domain, CASE WHEN conv_id % 7 <> 0 THEN composite * 100 END AS score FROM triad) SELECT domain, count(*) AS n, count(*) FILTER (WHERE score >= 80) AS n_passed, CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(score), 0) AS mean_score, 100.0::DOUBLE * count(*) FILTER (WHERE score >= 80) / count(*) AS pass_rate FROM e GROUP BY 1")
_EST = "CASE WHEN length(coalesce({c}, '')) = 0 THEN 0 ELSE greatest(1, length({c}) // 4) END"
_PRICED = {"gpt-4o-mini": (0.00015, 0.0006), "gemini-2.0-flash": (0.0001, 0.0004), "moonshot/unlisted": (0.002, 0.004)}
_rate = lambda k: "CAST(CASE model " + " ".join(f"WHEN '{m}' THEN {r[k]:.5f}" for m, r in _PRICED.items()) + " ELSE 0.00000 END AS DECIMAL(8,5))"
_TRACED = f"{_TURNS}, traces AS (SELECT *, [{', '.join(map(_text, MODELS))}][conv_id % {len(MODELS)} + 1] AS model, {_EST.format(c='prompt')} AS pt, {_EST.format(c='response')} AS ct, length(coalesce(prompt, '')) AS pl, length(coalesce(response, '')) AS rl FROM t)"
_add("telemetry_rollup", f"WITH {_TRACED} SELECT model, count(*) AS n_traces, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens, CAST(sum(CAST(round((CAST(pt AS DECIMAL(10,0)) * {_rate(0)} + CAST(ct AS DECIMAL(10,0)) * {_rate(1)}) * CAST(0.001 AS DECIMAL(4,3)), 6) AS DECIMAL(18,6))) AS DOUBLE) AS cost_usd, CAST(sum(pl + rl) AS DOUBLE) / count(*) AS mean_ms FROM traces GROUP BY 1")
_add("telemetry_tiers", f"WITH {_TRACED} SELECT 'vector' AS tier, count(*) AS n, CAST(sum(pl) AS DOUBLE) / count(*) AS mean_ms FROM traces UNION ALL SELECT 'graph', count(*), CAST(sum(rl) AS DOUBLE) / count(*) FROM traces")
_BUCKETS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)
_HISTOGRAM = " UNION ALL ".join([f"SELECT event_type, {e!r}::DOUBLE AS le, count(*) FILTER (WHERE value <= {e!r}) AS n FROM events GROUP BY 1" for e in _BUCKETS] + ["SELECT event_type, 1e9::DOUBLE AS le, count(value) AS n FROM events GROUP BY 1"])
_add("telemetry_histogram", _HISTOGRAM)
_add("telemetry_p95", f"""WITH h AS ({_HISTOGRAM}), w AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY le) AS n0, lag(le, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS le0, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type) AS rank FROM h)
SELECT event_type, round(CASE WHEN le >= 1e9 THEN le0 WHEN n = n0 THEN le ELSE le0 + (le - le0) * (rank - n0) / (n - n0) END, 6) AS p95 FROM w QUALIFY n >= rank AND row_number() OVER (PARTITION BY event_type, n >= rank ORDER BY le) = 1""")
_add("stream_quantiles", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS kind, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS quantile FROM events GROUP BY 1, 2")
_add("fn_scalars", "SELECT page_id, 'part' || CAST(page_id AS VARCHAR) AS local, md5(CASE WHEN length(html) > 100 THEN substr(html, 1, 100) || '...' ELSE html END) AS cut, regexp_full_match(url, '[A-Za-z_][A-Za-z0-9_]*') AS is_name, least(1.0::DOUBLE, CAST((page_id % 3) || '.25' AS DOUBLE)) AS score, 0.0::DOUBLE AS no_score FROM pages")
_add("telemetry_last_five", "SELECT event_type, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
_add("stream_sliding_rate", "SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_bad, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 4) AS bad_ratio FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
_add("stream_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
_add("stream_quantile_sketch", "SELECT event_type AS kind, count(*) AS n, TRUE AS within FROM events WHERE value IS NOT NULL GROUP BY 1")
_add("json_contains", "SELECT page_id FROM pages WHERE page_id % 11 <> 0 AND page_id % 2 = 0 AND page_id % 3 = 1 AND page_id % 5 = 4 AND length(html) > 1000")
ORACLES["scd2_change_log"] = ORACLES["scd2_apply_several"]
_add("graph_pattern_back", """SELECT b.deposit_balance_id AS balance, CAST(b.current_balance AS DOUBLE) AS amount, a.account_type, '[REDACTED]' AS number, c.customer_segment AS segment, '[REDACTED]' AS party, l.loan_agreement_id AS loan
FROM deposit_balance b JOIN deposit_account a ON a.deposit_account_id = b.deposit_account_id AND a.md_is_active JOIN party_role_customer c ON c.party_role_customer_id = a.customer_id AND c.md_is_active JOIN party p ON p.party_id = c.party_id AND p.md_is_active
LEFT JOIN (SELECT * FROM loan_agreement WHERE md_is_active) l ON l.customer_id = c.party_role_customer_id
WHERE b.md_is_active AND b.current_balance < 0 AND coalesce(l.is_npl, true) ORDER BY amount, balance, loan NULLS FIRST LIMIT 10""", "deposit_balance", "deposit_account", "party_role_customer", "party", "loan_agreement")
_add("graph_reach", """WITH RECURSIVE customer_n AS (SELECT * FROM party_role_customer WHERE md_is_active), party_n AS (SELECT * FROM party WHERE md_is_active), account_n AS (SELECT * FROM deposit_account WHERE md_is_active), balance_n AS (SELECT * FROM deposit_balance WHERE md_is_active),
application_n AS (SELECT * FROM loan_application WHERE md_is_active), loan_n AS (SELECT * FROM loan_agreement WHERE md_is_active), collateral_n AS (SELECT * FROM loan_collateral WHERE md_is_active),
one_way AS (
  SELECT 'Party:' || p.party_id AS a, 'Customer:' || c.party_role_customer_id AS b FROM party_n p JOIN customer_n c USING (party_id)
  UNION ALL SELECT 'Customer:' || c.party_role_customer_id, 'DepositAccount:' || d.deposit_account_id FROM customer_n c JOIN account_n d ON d.customer_id = c.party_role_customer_id
  UNION ALL SELECT 'DepositAccount:' || d.deposit_account_id, 'DepositBalance:' || b.deposit_balance_id FROM account_n d JOIN balance_n b USING (deposit_account_id)
  UNION ALL SELECT 'Customer:' || c.party_role_customer_id, 'LoanApplication:' || l.loan_application_id FROM customer_n c JOIN application_n l ON l.customer_id = c.party_role_customer_id
  UNION ALL SELECT 'Customer:' || c.party_role_customer_id, 'LoanAgreement:' || l.loan_agreement_id FROM customer_n c JOIN loan_n l ON l.customer_id = c.party_role_customer_id
  UNION ALL SELECT 'LoanApplication:' || x.loan_application_id, 'LoanAgreement:' || l.loan_agreement_id FROM application_n x JOIN loan_n l USING (loan_application_id)
  UNION ALL SELECT 'LoanAgreement:' || l.loan_agreement_id, 'LoanCollateral:' || k.loan_collateral_id FROM loan_n l JOIN collateral_n k USING (loan_agreement_id)),
edges AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way)),
walk AS (
  SELECT 'Customer:' || party_role_customer_id AS start, 'Customer:' || party_role_customer_id AS node, 0 AS hops FROM customer_n WHERE party_role_customer_id % 20 = 0
  UNION SELECT w.start, e.b, w.hops + 1 FROM walk w JOIN edges e ON e.a = w.node WHERE w.hops < 3),
met AS (SELECT start, node, min(hops) AS hops FROM walk GROUP BY start, node)
SELECT split_part(node, ':', 1) AS label, CAST(hops AS BIGINT) AS hops, count(*) AS n FROM met WHERE hops BETWEEN 1 AND 3 GROUP BY 1, 2""", "party_role_customer", "party", "deposit_account", "deposit_balance", "loan_application", "loan_agreement", "loan_collateral")
_add("eval_scenarios", "SELECT scenario, CAST(n AS BIGINT) AS n_checks, CAST(n AS BIGINT) AS n_passed, 100.0::DOUBLE AS score FROM (VALUES ('exposure', 7), ('liquidity', 1), ('credit', 3), ('quality', 2), ('tools', 3)) t(scenario, n)")

_ALLOWED = f"NOT contains(b, ';') AND regexp_matches(b, '(?i)^\\s*(?:SELECT|WITH|EXPLAIN)\\b') AND NOT regexp_matches(b, '(?i)\\b(?:{'|'.join(FORBIDDEN_SQL)})\\b')"
_PLAIN = "regexp_replace(text, '[\\x{80}-\\x{10FFFF}]', 'x', 'g')"  # letters beyond ASCII are no word's end
_add("guard_said", f"SELECT role, count(*) AS n, count(*) FILTER (WHERE {_ALLOWED}) AS n_as_is, count(*) FILTER (WHERE {_ALLOWED.replace('(b,', '(c,')}) AS n_selected FROM (SELECT role, {_BODY.replace('statement', _PLAIN)} AS b, {_BODY.replace('statement', f"'SELECT ' || {_PLAIN}")} AS c FROM conversations) GROUP BY role")
_INTENT = "CASE WHEN {0} THEN 'collateral' WHEN {1} THEN 'deposit' WHEN {2} THEN 'aml_risk' ELSE 'default' END".format(*(_HAS(w).replace("lower(prompt)", "lower(text)") for _, w in INTENTS))
_add("intent_of_turns", f"SELECT role, {_INTENT} AS intent, count(*) AS n FROM conversations GROUP BY 1, 2")
