"""The semantic model: cubes with measures, dimensions, joins and roll-ups.

In expressions $column is a column of the cube itself, $cube.column one of a joined cube, and
[measure] another measure's result.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Measure:
    kind: str  # count, sum, avg or number
    sql: str = ""
    where: str = ""


@dataclass(frozen=True)
class Join:
    to: str
    relationship: str  # belongs_to (N:1) or has_one (1:1)
    on: str


@dataclass(frozen=True)
class Cube:
    name: str
    key: str
    dimensions: tuple[str, ...]
    measures: dict[str, Measure]
    joins: tuple[Join, ...] = ()
    masked: tuple[str, ...] = ()
    rollups: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)


_ACTIVE = "$md_is_active = TRUE"


def _count(where: str = "") -> Measure:
    return Measure("count", where=where)


def _belongs(to: str, own: str, their: str) -> Join:
    return Join(to, "belongs_to", f"${own} = ${to}.{their}")


# Members of the cubes, their kinds and predicates.
CUBES: dict[str, Cube] = {
    c.name: c
    for c in (
        Cube("deposit_account", "deposit_account_id", ("deposit_account_id", "account_number", "customer_id", "account_type", "account_status", "currency_code", "opened_date", "md_is_active"), {
            "total_deposit_accounts": _count(_ACTIVE),
            "total_available_balance": Measure("sum", "$deposit_balance.available_balance"),
            "total_ledger_balance": Measure("sum", "$deposit_balance.ledger_balance"),
            "total_accrued_interest": Measure("sum", "$deposit_balance.accrued_interest"),
            "average_account_balance": Measure("avg", "$deposit_balance.available_balance"),
            "overdrawn_account_count": _count(f"$deposit_balance.current_balance < 0 AND {_ACTIVE}"),
            "total_overdrawn_amount": Measure("sum", "CASE WHEN $deposit_balance.current_balance < 0 THEN abs($deposit_balance.current_balance) ELSE 0 END"),
        }, (_belongs("party_role_customer", "customer_id", "party_role_customer_id"), Join("deposit_balance", "has_one", "$deposit_account_id = $deposit_balance.deposit_account_id AND $deposit_balance.md_is_active = TRUE"), _belongs("ref_currency", "currency_code", "currency_code"), Join("deposit_interest_term", "has_one", "$deposit_account_id = $deposit_interest_term.deposit_account_id AND $deposit_interest_term.md_is_active = TRUE")),
            rollups={"account_activity_rollup": (("total_deposit_accounts", "overdrawn_account_count"), ("deposit_account.account_type", "deposit_account.account_status", "deposit_account.currency_code"))}),
        Cube("deposit_balance", "deposit_balance_id", ("deposit_balance_id", "deposit_account_id", "currency_code", "available_balance", "current_balance", "ledger_balance", "accrued_interest", "as_of_timestamp", "md_is_active"), {
            "total_current_balance": Measure("sum", "$current_balance"),
            "total_available_balance": Measure("sum", "$available_balance"),
            "total_ledger_balance": Measure("sum", "$ledger_balance"),
            "total_accrued_interest": Measure("sum", "$accrued_interest"),
        }, (_belongs("deposit_account", "deposit_account_id", "deposit_account_id"),),
            rollups={"balance_totals_rollup": (("total_current_balance", "total_available_balance", "total_ledger_balance"), ("deposit_balance.currency_code", "deposit_account.account_type", "deposit_account.account_status"))}),
        Cube("deposit_interest_term", "deposit_interest_term_id", ("deposit_interest_term_id", "deposit_account_id", "interest_rate", "rate_type", "accrual_frequency", "calculation_basis", "effective_date", "md_is_active"), {"average_interest_rate": Measure("avg", "$interest_rate * 100")}, (_belongs("deposit_account", "deposit_account_id", "deposit_account_id"),)),
        Cube("deposit_overdraft_facility", "deposit_overdraft_facility_id", ("deposit_overdraft_facility_id", "deposit_account_id", "approved_limit", "interest_rate_penalty", "facility_status", "granted_date", "md_is_active"), {"total_approved_limit": Measure("sum", "$approved_limit"), "total_facility_count": _count()}, (_belongs("deposit_account", "deposit_account_id", "deposit_account_id"),)),
        Cube("deposit_transaction", "deposit_transaction_id", ("deposit_transaction_id", "transaction_reference", "transaction_type", "transaction_status", "currency_code", "booking_date", "value_date"), {
            "total_transactions": _count(),
            "total_deposit_volume": Measure("sum", "$amount", "$transaction_type IN ('DEPOSIT', 'TRANSFER_IN', 'INTEREST_CREDIT')"),
            "total_withdrawal_volume": Measure("sum", "$amount", "$transaction_type IN ('WITHDRAWAL', 'TRANSFER_OUT', 'FEE')"),
            "net_transaction_cashflow": Measure("number", "round([total_deposit_volume] - [total_withdrawal_volume], 4)"),
            "average_transaction_amount": Measure("avg", "$amount"),
        }, (_belongs("deposit_account", "deposit_account_id", "deposit_account_id"),)),
        Cube("loan_agreement", "loan_agreement_id", ("loan_agreement_id", "agreement_number", "customer_id", "loan_application_id", "agreement_status", "is_npl", "currency_code", "term_months", "disbursement_date", "maturity_date", "md_is_active"), {
            "total_loan_contracts": _count(_ACTIVE),
            "total_principal_exposure": Measure("sum", "$principal_amount", _ACTIVE),
            "average_loan_amount": Measure("avg", "$principal_amount", _ACTIVE),
            "average_interest_rate": Measure("avg", "$interest_rate * 100"),
            "npl_default_count": _count(f"$is_npl = TRUE AND {_ACTIVE}"),
            "npl_default_principal_exposure": Measure("sum", "$principal_amount", f"$is_npl = TRUE AND {_ACTIVE}"),
            "npl_default_ratio": Measure("number", "100.0 * [npl_default_count] / nullif([total_loan_contracts], 0)"),
        }, (_belongs("party_role_customer", "customer_id", "party_role_customer_id"), _belongs("loan_application", "loan_application_id", "loan_application_id"), _belongs("ref_currency", "currency_code", "currency_code")),
            rollups={"credit_risk_rollup": (("total_loan_contracts", "total_principal_exposure", "npl_default_count", "npl_default_principal_exposure"), ("loan_agreement.agreement_status", "loan_agreement.currency_code", "loan_agreement.is_npl"))}),
        Cube("loan_application", "loan_application_id", ("loan_application_id", "application_number", "customer_id", "application_status", "credit_score", "currency_code", "submission_date", "md_is_active"), {
            "total_applications": _count(),
            "approved_application_count": _count("$application_status = 'APPROVED'"),
            "total_requested_principal": Measure("sum", "$requested_amount"),
            "average_credit_score": Measure("avg", "$credit_score"),
        }, (_belongs("party_role_customer", "customer_id", "party_role_customer_id"),)),
        Cube("loan_collateral", "loan_collateral_id", ("loan_collateral_id", "collateral_type", "collateral_status", "currency_code", "valuation_date", "md_is_active"), {
            "total_collateral_assets": _count(),
            "total_appraised_value": Measure("sum", "$estimated_value"),
            "average_ltv_ratio": Measure("avg", "$ltv_ratio * 100"),
            "high_ltv_risk_count": _count(f"$ltv_ratio > 0.80 AND {_ACTIVE}"),
        }, (_belongs("loan_agreement", "loan_agreement_id", "loan_agreement_id"),)),
        Cube("loan_disbursement", "loan_disbursement_id", ("loan_disbursement_id", "loan_agreement_id", "disbursement_reference", "disbursed_amount", "currency_code", "disbursement_date", "disbursement_status", "md_is_active"), {"total_disbursed_amount": Measure("sum", "$disbursed_amount"), "total_disbursements_count": _count()}, (_belongs("loan_agreement", "loan_agreement_id", "loan_agreement_id"),)),
        Cube("loan_repayment_schedule", "loan_repayment_schedule_id", ("loan_repayment_schedule_id", "installment_number", "installment_status", "due_date", "paid_date", "md_is_active"), {
            "total_installments": _count(),
            "total_scheduled_due": Measure("sum", "$total_due"),
            "total_collected_amount": Measure("sum", "$paid_amount"),
            "overdue_installment_count": _count(f"$installment_status = 'OVERDUE' AND {_ACTIVE}"),
            "overdue_amount_exposure": Measure("sum", "CASE WHEN $installment_status = 'OVERDUE' THEN $total_due - $paid_amount ELSE 0 END"),
            "collection_fulfillment_rate": Measure("number", "100.0 * [total_collected_amount] / nullif([total_scheduled_due], 0)"),
        }, (_belongs("loan_agreement", "loan_agreement_id", "loan_agreement_id"),)),
        Cube("party", "party_id", ("party_id", "party_bk", "party_type", "status_code", "md_is_active"), {"total_party_masters": _count()}),
        Cube("party_address", "party_address_id", ("party_address_id", "party_id", "address_type", "street_address", "city", "postal_code", "country_code", "is_primary", "md_is_active"), {"total_addresses": _count()}, (_belongs("party", "party_id", "party_id"),)),
        Cube("party_identification", "party_identification_id", ("party_identification_id", "party_id", "id_type", "id_number", "issuing_country_code", "issue_date", "expiry_date", "verification_status", "md_is_active"), {"total_identifications": _count()}, (_belongs("party", "party_id", "party_id"),), ("id_number",)),
        Cube("party_individual", "party_individual_id", ("party_individual_id", "party_id", "first_name", "last_name", "date_of_birth", "gender", "citizenship_country_code", "tax_residence_country_code", "md_is_active"), {"total_individuals": _count()}, (_belongs("party", "party_id", "party_id"), _belongs("ref_country", "citizenship_country_code", "country_code")), ("date_of_birth", "gender")),
        Cube("party_organization", "party_organization_id", ("party_organization_id", "party_id", "legal_name", "trade_name", "registration_number", "incorporation_date", "incorporation_country_code", "nace_code", "legal_form", "md_is_active"), {"total_organizations": _count()}, (_belongs("party", "party_id", "party_id"), _belongs("ref_country", "incorporation_country_code", "country_code"), _belongs("ref_nace_industry", "nace_code", "nace_code")), ("registration_number",)),
        Cube("party_role_customer", "party_role_customer_id", ("party_role_customer_id", "customer_number", "party_id", "customer_segment", "kyc_status", "aml_risk_rating", "onboarding_date", "md_is_active"), {
            "total_customers": _count(),
            "active_customers_count": _count(_ACTIVE),
            "high_aml_risk_count": _count(f"$aml_risk_rating = 'HIGH' AND {_ACTIVE}"),
            "verified_kyc_count": _count(f"$kyc_status = 'VERIFIED' AND {_ACTIVE}"),
            "high_aml_risk_ratio": Measure("number", "100.0 * [high_aml_risk_count] / nullif([active_customers_count], 0)"),
        }, (_belongs("party", "party_id", "party_id"), Join("party_individual", "has_one", "$party_id = $party_individual.party_id"), Join("party_organization", "has_one", "$party_id = $party_organization.party_id")),
            rollups={"customer_risk_rollup": (("total_customers", "active_customers_count", "high_aml_risk_count", "verified_kyc_count"), ("party_role_customer.customer_segment", "party_role_customer.kyc_status", "party_role_customer.aml_risk_rating"))}),
        Cube("ref_country", "country_code", ("country_code", "country_name", "is_high_risk_aml"), {"total_countries": _count(), "high_risk_aml_country_count": _count("$is_high_risk_aml = TRUE")}),
        Cube("ref_currency", "currency_code", ("currency_code", "currency_name", "symbol", "is_active"), {"total_currencies": _count()}),
        Cube("ref_nace_industry", "nace_code", ("nace_code", "nace_title", "risk_level"), {"total_industries": _count(), "high_risk_industry_count": _count("$risk_level = 'HIGH'")}),
    )
}

# The curated view's members by the cube members they stand for.
CUSTOMER_360: dict[str, str] = (
    {m: f"party_role_customer.{m}" for m in ("customer_number", "customer_segment", "kyc_status", "aml_risk_rating", "total_customers", "active_customers_count", "high_aml_risk_count", "high_aml_risk_ratio")}
    | {f"deposit_account_{m}": f"deposit_account.{m}" for m in ("account_type", "account_status", "currency_code", "total_deposit_accounts", "total_available_balance", "overdrawn_account_count")}
    | {f"loan_agreement_{m}": f"loan_agreement.{m}" for m in ("agreement_status", "currency_code", "total_loan_contracts", "total_principal_exposure", "npl_default_count", "npl_default_ratio")}
)
VIEWS = {"customer_360": CUSTOMER_360}

# Members that only a privileged role may ask for. Masked dimensions are for no role.
PRIVILEGED = frozenset({"party_role_customer.aml_risk_rating", "party_role_customer.high_aml_risk_count", "party_role_customer.high_aml_risk_ratio", "ref_country.is_high_risk_aml", "ref_country.high_risk_aml_country_count", "ref_nace_industry.risk_level", "ref_nace_industry.high_risk_industry_count"})
MASKED = frozenset(f"{c.name}.{d}" for c in CUBES.values() for d in c.masked)
