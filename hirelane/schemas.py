"""Typed records: parsed resumes and job descriptions, and the rows of the dataset tables."""

from __future__ import annotations

RESUME = (
    "personal struct<full_name:string,email:string,phone:string,location:string,linkedin_url:string,github_url:string,portfolio_url:string>, "
    "summary string, "
    "skills array<struct<name:string,normalized_name:string,category:string,evidence:string,level:string>>, "
    "education array<struct<institution:string,degree:string,field_of_study:string,start_year:int,end_year:int,gpa:string,gpa_scale:string,description:string>>, "
    "experience array<struct<company:string,role:string,location:string,start_date:string,end_date:string,duration_months:int,responsibilities:array<string>,technologies:array<string>>>, "
    "projects array<struct<name:string,role:string,start_date:string,end_date:string,description:string,technologies:array<string>,urls:array<string>>>, "
    "certifications array<struct<name:string,issuer:string,issued_year:int,url:string>>, "
    "achievements array<struct<title:string,description:string,year:int>>, "
    "languages array<struct<name:string,proficiency:string>>"
)
JOB = (
    "title string, seniority string, employment_type string, responsibilities array<string>, requirements array<string>, nice_to_have array<string>, "
    "required_skills array<struct<name:string,normalized_name:string,is_core:boolean,weight_hint:double>>, "
    "preferred_skills array<struct<name:string,normalized_name:string,is_core:boolean,weight_hint:double>>, "
    "min_experience_years int, education_requirement string, domain_keywords array<string>"
)
PAIR = (
    "id string, resume_id string, job_description_id string, split string, label string, overall_score int, criterion_scores map<string,int>, "
    "matched_skills array<string>, missing_required_skills array<string>, label_notes string, label_version string"
)
LABELED_LINE = "doc_id string, line_index int, text string, label string"
CRITERIA = "array<struct<criterion:string,weight:double>>"
